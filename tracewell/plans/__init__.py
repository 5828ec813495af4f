"""Plan helpers and the query catalogue."""
