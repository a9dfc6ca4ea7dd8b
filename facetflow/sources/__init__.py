"""Builders, generators and storage of graphs."""
