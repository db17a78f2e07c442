"""Training-data operators: ten Spark jobs over tables of documents and vectors.

Nothing outside this subpackage imports it. ``registry`` lists the queries.
"""
