"""Operators that prepare code and text for training. Nothing else in the library imports this subpackage."""
