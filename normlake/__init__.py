"""PySpark-native retrieval, reference and knowledge-graph analytics."""
