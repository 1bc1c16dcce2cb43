"""Whole workflows composed from operators, and the catalogue of registered queries."""
