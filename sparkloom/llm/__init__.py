"""Operators on texts and training records; nothing else in the library imports this subpackage."""
