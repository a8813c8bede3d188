"""Column functions: native expressions, no shuffle."""
