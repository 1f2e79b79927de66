"""Spark-native analytics for 3'UTR variants, k-mers and binding affinities."""
