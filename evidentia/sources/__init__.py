"""Readers that never raise on bad data: what can't be read is a row with a reason."""
