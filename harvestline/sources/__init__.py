"""Readers, writers and the bindings that expose the star-schema tables as event feeds."""
