"""Operators that prepare text corpora for training. Nothing else in the library imports this package.

All operators share these rules. Text is UTF-8, a word is a run of characters other than space and U+0009 to U+000D,
and whole texts are read. Extra columns never matter: operators work on the columns they are told, under names of their
own. Empty tables give empty results with the same columns.
"""
