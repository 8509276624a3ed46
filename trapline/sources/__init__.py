"""Declared tables in; map layers and result pages out."""
