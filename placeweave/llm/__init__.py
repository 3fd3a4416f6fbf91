"""Operators for training-data pipelines over documents, vectors and conversations.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
