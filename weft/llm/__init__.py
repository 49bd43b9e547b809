"""Training-data operators: ten corpus operations, each in a module of its own.

Nothing else in the library imports this subpackage.
"""
