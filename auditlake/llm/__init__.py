"""Training-data operators for large document tables.

Nothing else in the package imports this subpackage.  Every operator takes
DataFrames, selects the columns it needs first (so extra columns can never
clash with its own) and returns a lazy DataFrame.
"""
