"""Operators for training-data pipelines: scoring, licences, joins, decontamination, extraction, mixing, sharding, dedup.

Nothing outside this folder imports it. Each operator lives in a module of its own; ``registry`` holds the queries.
"""
