"""Readers: source trees, graph documents, rule and model files."""
