"""Strataweave: keyed overlay merging and corpus preparation as Spark jobs."""
