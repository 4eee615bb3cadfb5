"""Text-change signal analytics on Spark."""
