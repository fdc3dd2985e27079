"""simvane.operators."""
