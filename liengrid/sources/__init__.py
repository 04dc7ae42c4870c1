"""Reading raw files and reading or writing tables."""
