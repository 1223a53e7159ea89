"""eventlake: a Spark-first analytics engine for event data and training corpora."""
