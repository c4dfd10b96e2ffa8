"""Sources of archive members."""
