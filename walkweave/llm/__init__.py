"""Training-data operators: one module for each operator, and ``queries`` for the registered ones."""
