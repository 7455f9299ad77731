"""Relational operators as DataFrame transformations: quality, profiles, ordering, metrics,
splits, model choice, decision layer and chart tables."""
