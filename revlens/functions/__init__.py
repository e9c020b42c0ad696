"""revlens.functions."""
