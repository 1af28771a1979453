"""Spark-native mining of functionally similar yet inconsistent items, with an optional corpus subpackage."""
