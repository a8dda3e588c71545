"""Value parsing (plain Python on literals) and the column functions of the engine."""
