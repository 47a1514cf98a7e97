"""Training-data operators on top of Spark DataFrames.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Each module holds one operator with its own general interface, and
``queries`` binds the operators to the tables of a data folder.
"""
