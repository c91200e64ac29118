"""Spark-first analytics for large, time-stamped, speaker-attributed text corpora."""
