"""Complete flows built from the operators."""
