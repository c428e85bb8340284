"""Question classification, decomposition, routing and execution."""
