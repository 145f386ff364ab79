"""Part of palimpsest."""
