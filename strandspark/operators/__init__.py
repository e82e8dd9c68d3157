"""Operators from DataFrame to DataFrame. Those that depend on an order take the ordering columns."""
