"""Rowloom: a PySpark engine that compares, reconciles and merges data sets."""
