"""Training-data operators: extraction, deduplication, scanning, scoring, encoding.

Each operator lives in its own module and has a general interface
(``DataFrame -> DataFrame``); ``registry`` holds the thin ``opN_`` queries with
the columns their contracts fix.  Nothing outside this subpackage imports it.
"""
