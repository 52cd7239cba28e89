"""Reproducible corruption of clean tables, and scores of plans that undo it.

Chance is a hash of (seed, operation, column, row key), so a table is corrupted
the same way in every run, partitioning and engine.
"""
