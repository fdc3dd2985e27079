"""simvane.functions."""
