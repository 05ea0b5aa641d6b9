"""Disclosure-risk and utility assessment of synthetic tables on Spark."""
