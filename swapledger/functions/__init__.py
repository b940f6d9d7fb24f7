"""Column expressions and split scans."""
