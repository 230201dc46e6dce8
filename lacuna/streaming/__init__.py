"""Streams with the semantics of the batch operators."""
