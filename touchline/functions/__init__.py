"""Column-level functions: formula vocabulary, pass geometry, text/date helpers."""
