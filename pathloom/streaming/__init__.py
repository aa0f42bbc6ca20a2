"""Transition extraction over a stream of visits."""
