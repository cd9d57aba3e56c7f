"""Compositions of operators into runs, and the registered query set."""
