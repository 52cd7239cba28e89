"""Column functions: coercion and null rules, and the safe expression language."""
