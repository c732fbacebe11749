"""Technical analytics over daily price bars, as Spark DataFrame plans."""
