"""Operators for training-data pipelines: filters, models, joins, packing, sharding.

Nothing outside this folder imports it; ``queries.py`` holds its registry.
"""
