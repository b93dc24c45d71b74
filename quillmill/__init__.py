"""Retrieval, curation and evaluation operators expressed as Spark DataFrame plans."""
