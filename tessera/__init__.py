"""Evidence-tracked knowledge analytics on PySpark."""
