"""codeloom: a PySpark-native analytics engine for code knowledge graphs."""
