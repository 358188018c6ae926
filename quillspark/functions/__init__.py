"""Column functions: text positions in bytes, running sums, whole-character windows."""
