"""Relational operators over documents, objects and pages."""
