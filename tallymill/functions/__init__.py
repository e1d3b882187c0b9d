"""Subpackage of tallymill."""
