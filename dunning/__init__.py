"""Receivables aging and credit-risk analytics as lazy Spark DataFrames.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected except tiny scalars documented at the call.

Entry points: :func:`dunning.sources.ingest.load_receivables` (landed files
-> typed tables), :func:`dunning.plans.prepare.prepare_statement`
(classification and scoring), the report areas in :mod:`dunning.plans`, and
:class:`dunning.plans.run.ReceivablesRun` for the whole page in one run.
"""

from dunning.params import ReportParams

__all__ = ["ReportParams", "ReceivablesRun", "load_receivables", "prepare_statement"]


def __getattr__(name):
    # lazy: importing the package does not need a Spark context
    if name == "ReceivablesRun":
        from dunning.plans.run import ReceivablesRun

        return ReceivablesRun
    if name == "load_receivables":
        from dunning.sources.ingest import load_receivables

        return load_receivables
    if name == "prepare_statement":
        from dunning.plans.prepare import prepare_statement

        return prepare_statement
    raise AttributeError(name)
