"""Forecasters as Spark jobs; ``registry.FORECASTERS`` lists them by name."""
