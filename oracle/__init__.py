"""DuckDB oracle SQL for every SQL-expressible report (correctness gate)."""
