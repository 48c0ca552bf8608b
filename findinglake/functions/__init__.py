"""Column-level functions: text, regex dialect, versions, globs, ranks."""
