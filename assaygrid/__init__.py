"""A Spark-native audit engine for region, motif and effect analytics."""
