"""Operators on panels: windows, cross-sections, as-of joins, factors, portfolios."""
