"""Transcript privacy analytics on Spark: spans, pseudonyms, alignment, rendering, job documents and live capture."""
