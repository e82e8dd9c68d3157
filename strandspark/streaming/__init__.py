"""Record files as streams: files that arrive in a folder are parsed as they come."""
