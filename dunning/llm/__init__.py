"""Operators for preparing text corpora on Spark: personal data, duplicates,
quality, decontamination, token files, archives and licences.

Nothing else in the library imports this subpackage.
"""
