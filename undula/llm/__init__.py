"""Operators for preparing language-model training data. Nothing else in undula imports this subpackage."""
