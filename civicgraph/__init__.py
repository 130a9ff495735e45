"""civicgraph: city-service analytics expressed as Spark DataFrame jobs."""
