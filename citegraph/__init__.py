"""citegraph: a PySpark-native engine for a cited knowledge graph."""
