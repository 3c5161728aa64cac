"""Lingweave: preparing, auditing, encoding and scoring parallel text corpora as Spark plans."""
