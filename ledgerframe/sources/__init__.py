"""Table sources: raw operational tables and the driver-table adapter."""
