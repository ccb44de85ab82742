"""Spark-native analytics over long documents: structuring, retrieval, entity resolution and evaluation.

Every operator is a function from DataFrames to DataFrames.  Nothing here keeps state in the driver; the
few iterative operators cut their lineage with tables written to the shared folder (see ``foliant.shared``).
"""
