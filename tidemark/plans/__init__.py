"""Registered queries: operators applied to the bound facts, each beside its SQL."""

MODULES = ("paths", "history", "links", "people", "graphs", "texts", "runs", "sources", "diagrams")
