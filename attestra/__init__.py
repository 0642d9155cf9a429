"""Document-verification analytics and training-data operators on Spark."""
