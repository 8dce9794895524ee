"""touchline: match-forecast analytics as Spark jobs."""
