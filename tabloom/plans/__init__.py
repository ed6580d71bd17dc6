"""Read-only SQL over a scope of tables, derived tables, and refreshes of sources."""
