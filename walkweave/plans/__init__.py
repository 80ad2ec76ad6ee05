"""Walkers, embedders and the pipeline made of operators, and the registered queries."""
