"""Market time-series and lending-risk analytics as Spark jobs."""
