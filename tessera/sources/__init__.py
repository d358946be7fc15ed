"""Table readers and the views that stand in for a service's tables."""
