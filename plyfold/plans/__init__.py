"""Encoding plans, documents made from them, and the advisor that chooses a level."""
