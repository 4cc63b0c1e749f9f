"""Operators for preparing language-model training text at cluster scale."""
