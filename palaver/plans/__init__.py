"""Payload tables made from the star-schema tables, and queries over them."""
