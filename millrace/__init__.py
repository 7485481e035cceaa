"""Analytics of machine-learning pipeline operations on Spark."""
