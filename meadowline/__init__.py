"""Reference-condition analytics on PySpark."""
