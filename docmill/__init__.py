"""docmill: document-intelligence analytics on PySpark."""
