"""Tailing containers that grow, and checking them as they do."""
