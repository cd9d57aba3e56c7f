"""roleweave — posting-to-profile matching as Spark DataFrame jobs.

Every public operator is ``DataFrame -> DataFrame`` (or ``-> Column`` for
row-local expressions in :mod:`roleweave.functions`).  Word lists, weights and
the notion of "now" (``as_of``) are arguments, defaulting to the fixed values
in :mod:`roleweave.functions.dictionaries`.
"""

__version__ = "0.1.0"
