"""A Spark-first engine for narrative text and entity resolution."""
