"""Millrace: a Spark-native SQL transformation and corpus-processing engine."""
