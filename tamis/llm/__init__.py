"""Operators for preparing language-model training corpora.

Nothing else in the package imports from here, so the folder can be removed as a whole.
"""
