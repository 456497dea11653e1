"""Folioscope: a PySpark-native engine for curating text corpora and for
analysing scored text.

Layers: ``sources`` (readers, sinks), ``functions`` (pure column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (registered queries with
their SQL oracles), ``streaming`` (Structured Streaming extension). The
subpackage ``llm`` holds the training-data operators and stands on its own.
"""
