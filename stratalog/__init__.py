"""stratalog: an analytics engine for indexed, replicated event logs on PySpark."""
