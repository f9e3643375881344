"""Training-data operators over the tables documents and conversations.

Nothing outside this subpackage imports it. Every module holds one operator with a general interface
(any DataFrame, any column names) and ``queries.py`` derives from it the query the checks run.
"""
