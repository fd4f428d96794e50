"""Column functions: calendar months and seeded draws."""
