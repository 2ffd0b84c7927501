"""Reusable DataFrame operators: roll-ups, ranking and time-band matching."""
