"""Data operators: materialisation, merging, comparison, quality tests, as-of joins."""
