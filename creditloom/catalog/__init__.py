"""Registered queries: each Spark job beside the SQL text that states the same result."""
