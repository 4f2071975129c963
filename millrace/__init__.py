"""Spark-native analytics over source text, change sets and analyser findings."""
