"""offerlens: price-comparison analytics on offer observations, as Spark DataFrame operators."""
