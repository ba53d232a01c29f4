"""Following a growing log."""
