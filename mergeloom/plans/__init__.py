"""Languages that compile to DataFrame plans."""
