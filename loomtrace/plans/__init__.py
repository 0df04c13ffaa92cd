"""Query plans made of several operators."""
