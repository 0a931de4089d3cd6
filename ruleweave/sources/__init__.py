"""Where facts come from and where they go."""
