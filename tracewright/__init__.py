"""Event-log conformance analytics on PySpark."""
