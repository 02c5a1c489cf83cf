"""Timed text segments on Spark: matching, merging, scoring and scheduling as DataFrame jobs."""
