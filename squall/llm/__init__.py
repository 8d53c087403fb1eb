"""Operators of a training-data pipeline: decontamination, license scans, token counts and files,
nearest neighbours, set-similarity joins, sharding, toxicity, quality and byte-level BPE.

Nothing else in the library imports this subpackage.
"""
