"""Evidence-grounded document analytics on Spark."""
