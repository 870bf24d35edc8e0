"""Subpackage of the layout analytics engine."""
