"""The named analytical jobs, grouped by task."""
