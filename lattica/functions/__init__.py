"""Functions of one graph in memory, and generators of graphs; the operators call them inside tasks."""
