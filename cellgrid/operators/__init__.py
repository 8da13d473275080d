"""Dataset-level operators; each takes and returns a CellData or DataFrame."""
