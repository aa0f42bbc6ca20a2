"""Transition analytics for ordered visit logs on Spark."""
