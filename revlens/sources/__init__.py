"""revlens.sources."""
