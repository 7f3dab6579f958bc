"""Training-data operators: one module per operator, thin contract queries in ``queries.py``."""
