"""Training-data operators: packing, media columns, search, dedup, scoring, tokenising, filtering.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``queries.py`` holds the thin ``opN_<name>`` queries that apply them to whole tables.
"""
