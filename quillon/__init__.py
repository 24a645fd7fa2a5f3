"""quillon: a PySpark-native engine for curating, auditing and evaluating corpora."""
