"""Part of tickloom: see README."""
