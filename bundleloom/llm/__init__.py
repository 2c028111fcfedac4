"""Operators for preparing training text and vectors at corpus scale.

Nothing outside this subpackage imports it.  Every operator takes DataFrames, selects the columns it
needs under internal names (so extra or clashing columns never matter) and returns a new DataFrame.
"""
