"""revlens.operators."""
