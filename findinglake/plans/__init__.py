"""Complete queries over the history and over one scan."""
