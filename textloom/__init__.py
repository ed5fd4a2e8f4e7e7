"""textloom: a text-corpus catalog engine on PySpark."""
