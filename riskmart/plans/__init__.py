"""Composite jobs and the registered queries (``catalog.queries()``)."""
