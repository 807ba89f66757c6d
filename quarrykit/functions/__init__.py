"""Part of the library; see the README for a map."""
