"""Query catalog: Spark queries and their SQL twins."""
