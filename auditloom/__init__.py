"""Dataset-audit analytics expressed as Spark DataFrame plans."""
