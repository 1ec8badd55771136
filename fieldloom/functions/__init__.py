"""Column functions: the missing-value contract, text, dates and fixed lookups."""
