"""Operators for preparing training data, each over whole tables; nothing else in the library imports them."""
