"""Operators for training data, one module per problem. Nothing else in the library imports this subpackage."""
