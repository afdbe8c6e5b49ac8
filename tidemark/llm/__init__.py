"""Operators that prepare text corpora for training language models.

Each module holds one operator with a general interface; ``queries`` applies
the operators, with production parameters, to the corpus tables.
"""
