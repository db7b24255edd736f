"""Puts the repository's top on the path of its tests."""
