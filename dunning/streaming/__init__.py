"""Incremental ingest of landed files.

The reference has no streaming logic: it re-reads its workbook on each page
load.  The Spark equivalent of that reload is an incremental file ingest:
new landed CSV exports are cleaned and appended to a typed table exactly
once, tracked by a streaming checkpoint (see :mod:`dunning.streaming.landing`).
No windowed or stateful streaming operator exists in the reference, so none
is built.
"""
