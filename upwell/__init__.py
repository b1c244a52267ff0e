"""Spark-native analytics over surging posts, and corpus preparation in ``upwell.llm``."""
