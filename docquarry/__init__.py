"""Spark-native analytics over time-stamped document collections.

Subpackages: ``sources`` (scans, sinks, ledgers), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame), ``plans`` (registered queries), ``streaming``.
"""
