"""Operators on training text and conversations; nothing else in the package imports this one."""
