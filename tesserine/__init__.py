"""Multi-model analytics operators expressed as Spark DataFrame plans."""
