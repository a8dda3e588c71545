"""Requests: the condition tree, its schema, its builder and its checks."""
