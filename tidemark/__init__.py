"""tidemark: Spark-first analytics for irregular readouts with right-censored outcomes."""
