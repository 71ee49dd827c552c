"""DataFrame operators: inventory, formula graph, classification, confirmation, coverage and checks."""
