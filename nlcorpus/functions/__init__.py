"""Column expressions and ordered / skew-safe building blocks shared by the operators."""
