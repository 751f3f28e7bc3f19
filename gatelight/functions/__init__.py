"""Part of gatelight; see README.md for the map of functions."""
