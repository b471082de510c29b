"""Column functions: native Catalyst expressions only."""
