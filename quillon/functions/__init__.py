"""Column functions: text normalisation, similarities, metrics."""
