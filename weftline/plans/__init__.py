"""Derived corpora and the registered queries with their reference SQL."""
