"""Subpackage of mossbrook."""
