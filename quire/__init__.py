"""Spark-native bookmark curation and analytics."""
