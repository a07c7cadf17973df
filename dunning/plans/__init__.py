"""Report areas built from the operators: each function returns a lazy
DataFrame over *all* customers at once."""
