"""Operators of a training-data pipeline: near and exact duplicates, classifiers, decontamination, tokens."""
