"""flowlens: options-flow analytics as Spark DataFrame operators."""
