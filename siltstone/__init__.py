"""Corpus question answering and training-data preparation on PySpark."""
