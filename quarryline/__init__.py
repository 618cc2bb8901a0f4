"""Evidence retrieval, guarding and corpus preparation on Spark."""
