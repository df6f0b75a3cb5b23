"""Operators that prepare text corpora for training.

Every operator selects the columns it is told to use by name and carries only
the id besides, so that other columns, whatever they are called, do not matter.
"""
