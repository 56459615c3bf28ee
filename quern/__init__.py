"""Crawl, extract, chunk, index and search text corpora with Spark."""
