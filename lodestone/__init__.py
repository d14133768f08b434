"""Spark-first engine for retrieval, document ETL and corpus processing."""
