"""Plans, the runner and the query catalogue."""
