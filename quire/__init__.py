"""Spark-native analytics for collections of paginated documents."""
