"""simvane.streaming."""
