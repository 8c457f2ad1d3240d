"""Training-data operators: ten standalone modules, each with one DataFrame operator and its registered query.

Nothing outside this subpackage imports it.
"""
