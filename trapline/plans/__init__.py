"""User-level queries over the survey tables."""
