"""Operators for preparing training data: dedup, filters, packing, sharding, search.

Nothing outside this folder imports it. Frames go in and come out; intermediate
tables are written below ``spark.checkpoint.dir`` (see ``store``).
"""
