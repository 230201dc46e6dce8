"""Training-data operators: thirteen corpus-scale components and their queries.

Nothing outside this subpackage imports it.
"""
