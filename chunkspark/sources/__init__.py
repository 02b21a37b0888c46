"""Where assets and domains come from."""
