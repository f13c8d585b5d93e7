"""Column helpers: safe casts, text comparison, rounding, dates and periods."""
