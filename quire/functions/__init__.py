"""Scalar functions: strings, numbers, geometry, compression, encryption."""
