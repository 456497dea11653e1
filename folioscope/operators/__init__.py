"""operators of folioscope."""
