"""Relational operators on fields, and the tree construction built from them."""
