"""Operators for building training data from a knowledge base. Nothing outside this folder imports it."""
