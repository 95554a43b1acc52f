"""DataFrame operators, one module per capability."""
