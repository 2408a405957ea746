"""Operators of a training-data pipeline: sharding, dedup, decontamination, scans, packing and file formats."""
