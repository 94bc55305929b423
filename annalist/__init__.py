"""Evidence timelines as PySpark DataFrame operators."""
