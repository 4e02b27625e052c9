"""graftline: dependency-update analytics expressed as Spark DataFrame plans."""
