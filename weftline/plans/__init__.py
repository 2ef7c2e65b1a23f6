"""Whole plans: the retrieval pipeline and the catalogue of registered queries with their SQL."""
