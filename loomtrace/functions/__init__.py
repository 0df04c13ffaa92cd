"""Scalar functions: Columns in ``columns``, their driver-side and per-session twins in ``plain``."""
