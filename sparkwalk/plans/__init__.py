"""User-level jobs, in pipeline order."""
