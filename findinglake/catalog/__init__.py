"""Registered queries over the given tables, each with an independent SQL oracle."""
