"""A Spark-first engine for monitoring listing pages and preparing text corpora."""
