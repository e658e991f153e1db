"""Corpus operators for training-data pipelines.

Every module holds one operator with its own general interface; ``queries``
holds the thin ``opN_<name>`` queries that the driver runs.
"""
