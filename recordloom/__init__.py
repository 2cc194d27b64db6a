"""recordloom: a PySpark-native engine for ledgers of immutable typed records.

Sub-packages: ``sources`` (tables in), ``functions`` (columns), ``operators``
(DataFrame to DataFrame), ``plans`` (queries made of operators), ``streaming``
(incremental catch-up) and the optional ``llm`` (training-data operators).
"""
