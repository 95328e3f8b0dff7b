"""Column functions: tokens and lengths, padding and slicing, costs, log and name parsing."""
