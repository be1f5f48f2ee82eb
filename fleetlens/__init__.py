"""Fleet observability and data-migration checks as Spark DataFrame operators."""
