"""Bindings of the operators to tables, and the registered queries."""
