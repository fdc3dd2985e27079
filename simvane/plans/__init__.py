"""simvane.plans."""
