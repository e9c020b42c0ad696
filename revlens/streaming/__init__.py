"""revlens.streaming."""
