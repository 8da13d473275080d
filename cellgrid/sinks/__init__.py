"""Writers: MEX directory, cell/gene metadata tables, dense text matrix."""
