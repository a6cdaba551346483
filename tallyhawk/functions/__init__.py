"""Part of tallyhawk; see the README."""
