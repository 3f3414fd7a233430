"""The operators applied to the standard tables, with the same questions in plain SQL."""
