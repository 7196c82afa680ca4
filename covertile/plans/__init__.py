"""Views of the standard tables as domain tables, and the catalogue of queries on them."""
