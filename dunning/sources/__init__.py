"""Sources (landed files, the TPC-H derived fixture) and CSV sinks."""
