"""Evidence-based history ranking and data preparation on Spark."""
