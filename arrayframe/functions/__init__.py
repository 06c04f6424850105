"""Expressions of derived variables: parsing, typing, compilation to columns, stencils."""
