"""Column builders: each one takes and returns Columns, with no Python in the plan."""
