"""Operators over the tables of a spectral-imaging campaign."""
