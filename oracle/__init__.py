"""DuckDB oracle SQL for every registered query (independent re-statement of
the same semantics in plain SQL over the driver's tables)."""
