"""Operators for text corpora used to train language models.

Nothing outside this folder imports it.  Each module holds one operator with a
general DataFrame interface; ``queries.py`` binds them to the test tables.
"""
