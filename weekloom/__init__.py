"""weekloom: weekly panel forecasting as Spark DataFrame jobs."""
