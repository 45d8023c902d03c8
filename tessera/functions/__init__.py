"""Column-to-Column functions made of Spark built-ins only."""
