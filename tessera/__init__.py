"""tessera: a PySpark-native analytics engine of named, checkable queries."""
