"""Market-bar analytics and corpus preparation on PySpark."""
