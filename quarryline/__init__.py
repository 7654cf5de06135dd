"""quarryline: Spark-first text, catalogue and usage analytics."""
