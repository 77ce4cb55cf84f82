"""Product-structure analytics on Spark."""
