"""Operators for building training data: one module per problem, queries in ``registry``."""
