"""lumenmill: a PySpark-native analytics engine (relational, OLAP, streaming, document)."""
