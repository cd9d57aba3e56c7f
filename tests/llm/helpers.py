"""Small tables with the awkward rows every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or give out.
CLASHES = ("score", "fp", "ids", "decoded", "found", "hash", "part", "n_words", "shares", "kept", "row_key", "v", "label", "component_id", "text_hash")


def documents(spark, rows, clashes=True):
    """``rows`` of (doc_id, text, lang, source) as documents, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)
    return df.withColumns({c: F.lit("extra") for c in CLASHES}) if clashes else df


def words(rng, n, stems):
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 4))) for _ in range(n))


STEMS = {"aa": ["the", "in", "on", "ha", "er", "st"], "bb": ["ß", "ch", "ü", "der", "ein", "ge"], "cc": ["é", "ou", "eau", "x", "que", "le"]}


def corpus(n=60, seed=3):
    """Texts of three invented languages: (doc_id, text, lang, source)."""
    rng = random.Random(seed)
    langs = sorted(STEMS)
    return [(i, words(rng, rng.randint(12, 60), STEMS[langs[i % 3]]), langs[i % 3], f"s{i % 4}") for i in range(n)]


AWKWARD = [(900, None, "aa", "s1"), (901, "", None, None), (902, " \t\n", "bb", "s2"), (903, "1234 !?", "cc", "s3"), (None, "the inon haer", "aa", "s1"),
           (904, "the inon haer", "aa", "s1"), (904, "the inon haer", "aa", "s1"), (905, "x" * 30000, "aa", "s2")]
