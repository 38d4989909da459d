"""Sports-market analytics on PySpark."""
