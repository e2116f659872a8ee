"""Spark-native engine for knowledge-base workloads: ingestion, retrieval, analytics and change data."""
