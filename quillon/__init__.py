"""Quillon: a PySpark-native analytics engine for sequence, assay and text tables."""
