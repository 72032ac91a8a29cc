"""The registered query catalogue (Spark) and its oracle SQL (DuckDB)."""
