"""functions of folioscope."""
