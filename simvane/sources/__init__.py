"""simvane.sources."""
