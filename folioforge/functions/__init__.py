"""Subpackage of folioforge."""
