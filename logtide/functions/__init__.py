"""Column expressions: request classification, calendars, shares, URLs."""
