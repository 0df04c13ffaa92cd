"""Training-data operators: one module per operator, thin query bindings in ``queries``."""
