"""docloom: a Spark-native document-graph retrieval engine."""
