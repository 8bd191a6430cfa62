"""docloom: a Spark-first document analytics engine."""
