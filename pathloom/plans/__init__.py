"""Registered queries of the operators, with their SQL."""
