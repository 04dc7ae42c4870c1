"""Property tax-sale analytics as Spark DataFrame plans."""
