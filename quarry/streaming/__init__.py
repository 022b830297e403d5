"""Incremental refresh over file streams."""
