"""Plan shapes shared by the operators: time slices, broadcast guard, tier choice."""
