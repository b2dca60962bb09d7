"""Column expressions: calendar, solar geometry, wind physics, scalar rules."""
