"""Training-data operators: ten corpus operators and the pipeline built from them.

Nothing else in the library imports this subpackage. Every operator takes DataFrames and
column names, selects the columns it needs first (extra columns, whatever their names, never
clash), and returns a DataFrame. Intermediate tables go to the folder that the session names
in ``spark.checkpoint.dir``.
"""
