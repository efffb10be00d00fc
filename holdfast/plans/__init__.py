"""Bindings of the operators to concrete tables, one module per report family."""
