"""Column expressions over report text, dates, addresses and codes."""
