"""Operators from DataFrame to DataFrame that are more than one expression."""
