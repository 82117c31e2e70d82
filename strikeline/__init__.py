"""Analytics for option chains and volatility histories as Spark jobs."""
