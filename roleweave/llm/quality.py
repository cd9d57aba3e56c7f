"""Quality rules with adaptive thresholds, in DataFrame functions only.

Features of each document are computed within its row.  For every language and source,
mergeable quantile sketches (Spark's ``percentile_approx``: one small summary for each task
and group, merged after the shuffle) give the quartiles of each ratio; a document fails
when a ratio lies beyond the far fence of its own group.  Repeats are absent from most
documents, so their quartiles are those of the documents that have any.  The fences
replace fixed cutoffs; the fixed base rule stands beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import saved

#: Fixed values of the contract.
BLANK, SYMBOLS, WINDOW, FEWEST_WORDS, MOST_REPEATED = r"[\x20\x09-\x0D]+", "#*$%&|<>", 5, 10, 20
#: Accuracy of the sketches.
ACCURACY = 10_000
#: (feature, whether low values fail too, whether only values above zero make the quartiles,
#: how many quartile distances a value may lie beyond them, least quartile distance: the size of rounding).
RULES = (
    ("mean_word", True, False, 6.0, 0.05), ("symbol_ratio", False, False, 6.0, 0.005),
    ("dup_line_ratio", False, True, 3.0, 0.02), ("repeat_ratio", False, True, 3.0, 0.02),
)


def _bound(value: Column, use) -> Column:
    """``use(x)`` with x computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that occurs at least twice, the first included.

    Windows are told apart by a 64-bit hash; sorting (hash, place) brings equal ones
    side by side, and the union of the repeated ones' spans is summed over their sorted
    places, so the work is n log n in a text's words.
    """

    def count(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(1), F.size(w) - (size - 1)),
            lambda i: F.struct(F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]).alias("h"), i.alias("i")),
        )

        def places(s: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k + 1) | same(x, k - 1)), lambda x: x["i"]))

        repeated = _bound(F.array_sort(hashed), places)
        covered = _bound(
            repeated,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, x: a + x
            ),
        )
        return F.when(F.size(w) < size, F.lit(0)).otherwise(covered)

    return _bound(words, count).cast("long")


def features(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``doc_id``, the group columns, and the counts of every row; null text has no words.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (lines with a word),
    ``n_dup_lines``, ``n_repeat_words``.
    """
    rows = documents.select(
        documents[id_col].alias("doc_id"), *[documents[g].cast("string").alias(f"group_{i}") for i, g in enumerate(group_cols)],
        F.coalesce(documents[text_col].cast("string"), F.lit("")).alias("text"),
    )
    text = F.col("text")
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = sum((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in SYMBOLS), F.lit(0))
    blank = sum((F.length(text) - F.length(F.replace(text, F.lit(s), F.lit(""))) for s in " \t\n\x0b\x0c\r"), F.lit(0))
    counted = _bound(
        words,
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")),
    )
    line_counts = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    groups = [f"group_{i}" for i in range(len(group_cols))]
    out = rows.select(
        "doc_id", *groups, counted.alias("w"), line_counts.alias("l"),
        (F.length(text) - blank).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
    )
    return out.select("doc_id", *groups, "w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def _ratios(counts: DataFrame) -> DataFrame:
    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return counts.withColumns({
        "mean_word": over("word_chars", "n_words"), "symbol_ratio": over("n_symbols", "word_chars"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"), "repeat_ratio": over("n_repeat_words", "n_words"),
    })


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), fence: float = 1.0) -> DataFrame:
    """The rows of :func:`features` with the ratios, ``base_failed``, ``failed`` (names of the rules) and ``kept``.

    A null in a group column is a group of its own.  Quartiles come from the documents
    that pass the base rule; a group of which none does, or a ratio at its fence, fails
    nothing.  ``fence`` scales how far beyond the quartiles all fences lie.  Every input
    row comes out once, repeated rows alike.
    """
    groups = [f"group_{i}" for i in range(len(group_cols))]
    rows = _ratios(saved(features(documents, id_col, text_col, group_cols))).withColumn(
        "base_failed", (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    )
    passing = rows.where(~F.col("base_failed"))
    sketches = passing.groupBy(*groups).agg(
        *[F.percentile_approx(F.when(F.col(name) > 0, F.col(name)) if present else F.col(name), [0.25, 0.75], ACCURACY).alias(f"q_{name}") for name, _, present, *_ in RULES]
    )
    joined = rows.alias("r").join(sketches.alias("s"), [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups], "left")
    fails = []
    for name, low, _, times, least in RULES:
        first, third = F.get(f"q_{name}", F.lit(0)), F.get(f"q_{name}", F.lit(1))
        reach = F.lit(fence * times) * F.greatest(third - first, F.lit(least))
        beyond = F.col(name) > third + reach
        if low:
            beyond = beyond | (F.col(name) < first - reach)
        fails.append(F.when(beyond, F.lit(name)))
    failed = F.array_compact(F.array(*fails))
    out = joined.select("r.*", failed.alias("failed"))
    named = [F.col(g).alias(c) if c not in rows.columns else F.col(g).alias(f"{c}_group") for g, c in zip(groups, group_cols)]
    return out.select(
        "doc_id", *named, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        *[n for n, *_ in RULES], "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"),
    )
