"""Rule programs and their rewriting, before any data is read."""
