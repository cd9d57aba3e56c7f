"""Secret scans with corpus-wide ownership frequency.

Candidates are found by pattern in every whole text and hashed.  How many distinct owners
and repositories hold a hash tells copies of a published example from a credential of
somebody's own.  A value is ``example`` when at least ``OWNERS`` distinct owners or at least
``REPOSITORIES`` distinct repositories hold it, whatever the corpus' size: many owners
don't share a credential, and one owner doesn't spread it over many repositories.  Any
other is ``live``.
The base kinds are reported whatever their class.  The method adds ``token`` spans: bare
random-looking runs that the base kinds miss, where the whole corpus shows them to be
owner-specific.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from roleweave.llm.common import saved, tidy

#: Fixed values of the contract: kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: The method's own kind: a bare run of at least so many characters with this entropy (bits a character).
TOKEN, TOKEN_CHARS, TOKEN_BITS = "token", 24, 3.5
BARE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % TOKEN_CHARS)
#: A value held by at least so many owners, or by so many repositories of whatever owners, is a widely copied example.
OWNERS, REPOSITORIES = 3, 10

_RUN = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_BARE = bytes(1 if re.match(r"[A-Za-z0-9+/_-]", chr(b)) and b < 128 else 0 for b in range(256))


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _random_looking(s: str) -> bool:
    kinds = [bool(re.search(c, s)) for c in ("[a-z]", "[A-Z]", "[0-9]")]
    return kinds[2] and sum(kinds) >= 2 and _entropy(s) >= TOKEN_BITS and len(re.findall("[0-9]", s)) >= len(s) // 8


def find(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every candidate by start, then kind; code points, end exclusive.

    Cheap tests on the bytes tell which patterns can match at all.
    """
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out: list[tuple[str, int, int, str]] = []
    if (b"=" in raw or b":" in raw) and (b"passw" in low or b"secret" in low or b"token" in low or b"api" in low):
        out += [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    if b"\1" * LEAST["hex"] in raw.translate(_RUN):
        out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    if b"\1" * TOKEN_CHARS in raw.translate(_BARE):
        taken: list[tuple[int, int]] = []  # the base spans' union, to look overlaps up in
        for s, e in sorted((s, e) for _, s, e, _ in out):
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        ends = [e for _, e in taken]
        for m in BARE.finditer(text):
            k = bisect_right(ends, m.start())
            if (k == len(taken) or taken[k][0] >= m.end()) and _random_looking(m[0]):
                out.append((TOKEN, m.start(), m.end(), m[0]))
    order = {k: i for i, k in enumerate((*KINDS, TOKEN))}
    return sorted(out, key=lambda x: (x[1], order[x[0]]))


_CANDIDATE = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            [{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in find(t)] if t else []
            for t in batch.column(batch.num_columns - 1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_CANDIDATE))], [*batch.schema.names[:-1], "found"])


@F.pandas_udf(BooleanType())
def holds_candidate(text: pd.Series) -> pd.Series:
    """Whether :func:`find` finds anything in a text."""
    return text.map(lambda t: bool(t) and bool(find(t))).astype(bool)


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """``doc_id``, ``owner``, ``found`` (an array of kind, start, end, hash) of every row; one narrow pass."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(documents[id_col].alias("doc_id"), documents[owner_col].cast("string").alias("owner"), documents[text_col].cast("string").alias("text"))
    return rows.mapInArrow(tidy(_scan), f"doc_id {kind}, owner string, found array<struct<kind:string,start:bigint,end:bigint,hash:string>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """``hash``, ``owners``, ``repositories``: in how many distinct owners and documents each value occurs.

    Repeats are taken out before the counts are shuffled by hash, so a widely copied
    value brings one row for each owner and document at most.  A null owner is an owner
    like any other; a null id is one repository.
    """
    held = scanned.select("doc_id", "owner", F.explode("found.hash").alias("hash")).distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", min_owners: int = OWNERS, min_repositories: int = REPOSITORIES) -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end) and ``live`` (spans that are no example).

    ``base`` has the contract's kinds; ``spans`` has them and the method's ``token``
    spans, which only values of fewer than ``min_owners`` owners and ``min_repositories``
    repositories become; both are sorted by start, then kind.  A null or empty text has none.  Rows that hold no candidate
    never meet a shuffle by hash.  A null id and repeated ids keep a row each: each row
    carries its own spans.
    """
    scanned = saved(scan(documents, id_col, text_col, owner_col))
    wide = ownership(scanned).where((F.col("owners") >= min_owners) | (F.col("repositories") >= min_repositories)).select("hash", "owners")
    # a row's candidates stay together under a key of their own; equal rows share it, as their spans are equal
    holding = scanned.where(F.size("found") > 0).withColumn("row_key", F.xxhash64(F.col("doc_id"), F.to_json("found")))
    each = holding.select("row_key", F.explode("found").alias("x")).distinct().select("row_key", "x.*")
    place = F.array_position(F.array(*map(F.lit, (*KINDS, TOKEN))), F.col("kind"))
    judged = each.join(wide, "hash", "left").groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "kind", "end", F.col("owners").isNotNull().alias("copied")))).alias("judged")
    )
    none = F.array().cast("array<struct<start:bigint,place:bigint,kind:string,end:bigint,copied:boolean>>")
    rows = scanned.where(F.size("found") == 0).select("doc_id", none.alias("judged")).union(
        holding.select("doc_id", "row_key").join(judged, "row_key").select("doc_id", "judged")
    )

    def spans(keep):
        return F.transform(F.filter("judged", keep), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return rows.select(
        "doc_id",
        spans(lambda x: x["kind"] != TOKEN).alias("base"),
        spans(lambda x: (x["kind"] != TOKEN) | ~x["copied"]).alias("spans"),
        spans(lambda x: ~x["copied"]).alias("live"),
    )


def written(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
