"""Readers, schema conformance and the clinical views of the given tables."""
