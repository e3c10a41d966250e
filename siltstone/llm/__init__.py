"""Training-data operators. Nothing else in siltstone imports this subpackage."""
