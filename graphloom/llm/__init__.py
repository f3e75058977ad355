"""Training-data operators over document and embedding tables.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries.py`` binds them to the test tables.
"""
