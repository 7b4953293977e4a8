"""Operators for preparing language-model training data.

Self-contained: nothing else in the library imports this package. Each module
holds one operator; ``queries`` registers the thin ``opN_<name>`` queries.
"""
