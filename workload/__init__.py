"""Binding of the operators to the test tables, and the SQL their results are checked with."""
