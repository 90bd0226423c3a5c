"""Operators over the revision corpus; each takes and returns DataFrames."""
