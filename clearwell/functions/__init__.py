"""Column selectors, shared expressions and statistics."""
