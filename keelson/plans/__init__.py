"""Plan shapes shared by the operators: bounded ranking and exact order work on hot groups."""
