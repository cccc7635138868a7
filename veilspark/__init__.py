"""Private marginal analytics on Spark."""
