"""Helpers that shape physical plans: storage, iteration and order."""
