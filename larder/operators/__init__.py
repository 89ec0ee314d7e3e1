"""Analytics operators, grouped by subject. Each maps named tables to one DataFrame."""
