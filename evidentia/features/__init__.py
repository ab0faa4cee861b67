"""The 145 features of a nested record, their groups, bounds and contracts."""
