"""Operators for preparing language-model training data. Nothing else in sijill imports this subpackage."""
