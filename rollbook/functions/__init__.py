"""Column expressions: keys, dates, recodes and geometry."""
