"""Repeated runs over growing data: the high-water mark of the last successful run and the run log."""
