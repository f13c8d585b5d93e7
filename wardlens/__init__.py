"""Provider-quality analytics as PySpark DataFrame, SQL and ML-pipeline jobs."""
