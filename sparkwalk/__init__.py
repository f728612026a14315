"""Walking-network analytics as PySpark DataFrame jobs."""
