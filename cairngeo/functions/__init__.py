"""Column expressions: geometry, projections, cells, text, feeds, points."""
