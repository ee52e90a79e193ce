"""Content-addressed analytics and corpus preparation on Spark."""
