"""Operators for preparing large text collections. Nothing else in the library imports this subpackage."""
