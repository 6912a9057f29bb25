"""Operators of a training-data pipeline, one module each.

``queries`` and ``oracle_sql`` (module ``registry``) give their registered
queries. Nothing outside this subpackage imports it, but for the driver's
entry module, which adds its queries when it is there.
"""
