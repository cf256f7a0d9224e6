"""Product catalogue building, querying and extraction scoring on Spark."""
