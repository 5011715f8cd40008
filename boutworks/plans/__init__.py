"""Queries over the star-schema tables; importing the modules registers them."""
