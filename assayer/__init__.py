"""Dataset quality checks and corpus operators as Spark DataFrame plans."""
