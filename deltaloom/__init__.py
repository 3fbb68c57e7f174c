"""Spark-native analytics for collections of low-rank adapter weight files."""
