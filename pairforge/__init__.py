"""pairforge: a Spark-native engine for paired corpora and their retrieval analytics."""
