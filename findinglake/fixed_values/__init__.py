"""Values that results depend on literally: enums, word lists, patterns, formats."""
