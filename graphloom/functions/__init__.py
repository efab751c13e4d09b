"""Column functions of the engine."""
