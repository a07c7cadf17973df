"""DataFrame-level operators Spark has no single built-in for: a skew-proof
global running total, greedy goal cut, modal value, box summaries, histogram,
exact median."""
