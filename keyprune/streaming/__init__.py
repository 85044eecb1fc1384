"""The work queue."""
