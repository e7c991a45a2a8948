"""Operators for preparing large text collections; ``catalog`` holds their named queries."""
