"""Operators over graphs and relations."""
