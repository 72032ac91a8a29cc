"""Operators of a training-data pipeline, and their registered queries.

Nothing else in the package imports this subpackage; ``__spark_entry__``
adds its queries when it is there.
"""
