"""Operators of a training-data pipeline over a table of documents.

Every operator takes a DataFrame with an id and a text column, names of both being parameters, and
leaves all other columns alone: results carry the input row as one struct column ``row``, so no
column of the input can clash with one of the operator.
"""
