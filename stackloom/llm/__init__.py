"""Training-data operators. Nothing else in stackloom imports this subpackage."""
