"""Column functions: native expressions, no row-at-a-time Python."""
