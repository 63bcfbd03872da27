"""Spark-first engine for image-post analytics: retrieval, ingest, clustering, corpus statistics."""
