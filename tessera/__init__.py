"""Daily cross-sectional equity research on Spark."""
