"""Operators for preparing training text: counting, joining, filtering, cleaning, mixing, storing."""
