"""Derived views of the generated tables and the registered queries on them."""
