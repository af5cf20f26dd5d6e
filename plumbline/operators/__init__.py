"""Operators over one table: column roles, splits, preprocessing."""
