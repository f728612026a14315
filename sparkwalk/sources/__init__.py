"""Layer catalog and feature files."""
