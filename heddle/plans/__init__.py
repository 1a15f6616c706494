"""Bindings of operators to tables: the registered queries and their SQL twins."""
