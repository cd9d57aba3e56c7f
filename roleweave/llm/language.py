"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of orders 0 to ``order`` holds, for every context
met in training, how often each byte followed.  A byte's code length comes from the
longest context that is in the tree; a byte new to that context costs an escape and is
coded by the next shorter one, with the bytes of the longer context excluded (method C),
down to equal shares of the bytes never met.  After training the counts are frozen, so
the code length of a byte is a function of its context alone: each worker lays the
lengths of all contexts and languages out in one table, and a text's exact code length
under every language is a sum of table rows over its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import kept_in_worker, lowest_hashes, tidy, utf8, within_limits

#: Longest context in bytes.  With one byte more it fills 32 bits, which the n-gram codes use.
ORDER = 3
#: Distinct training texts a language at most: the bound on what the counts are learned from.
TEXTS_PER_LANGUAGE = 400
#: Tasks that count the sample's n-grams, and distinct n-grams that one holds of a language before it merges them.
COUNTING_TASKS, GRAMS_HELD = 4, 1 << 20
#: Bytes scored at a time.
BYTES = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class PpmCounts:
    """Frozen statistics: (order + 1)-gram codes, their counts by language, and whole short contexts.

    ``codes[n]`` are n-grams (big-endian bytes) at the start of a text, for n <= order,
    which have no full context; ``codes[order + 1]`` are all others.
    """

    languages: tuple[str, ...]
    order: int
    codes: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]

    @property
    def key(self) -> str:
        h = hashlib.sha256(repr((self.languages, self.order)).encode())
        for c, n in zip(self.codes, self.counts):
            h.update(c.tobytes() + n.tobytes())
        return h.hexdigest()


class PpmTable:
    """Code lengths in nats by context, byte and language."""

    def __init__(self, model: PpmCounts):
        order, langs = model.order, len(model.languages)
        grams = self._grams(model)
        seen = np.flatnonzero(np.bincount(grams[0][0][:, -1], minlength=256)) if len(grams[0][0]) else np.zeros(0, int)
        self.symbols = a = len(seen)
        #: Byte to symbol: ``a`` for bytes no language has met, ``a + 1`` before a text's start.
        self.symbol = np.full(256, a, np.int64)
        self.symbol[seen] = np.arange(a)
        self.wide = w = a + 2
        # order 0
        full, after = np.zeros((1, a + 1, langs), np.float32), np.zeros((1, a + 1, langs), np.float32)
        hits = np.zeros((1, a + 1, langs), np.int32)
        hits[0, self.symbol[grams[0][0][:, -1]]] = grams[0][1]
        rest = 256 - (hits[:, :a] > 0).sum(axis=1, keepdims=True)
        after[:] = 1 / np.maximum(rest, 1)
        self._fill(hits, full, after, after.copy())
        lengths, place, escapes = [full], {b"": 0}, [after]
        seen_by, total = [hits], 1
        #: ``steps[d][node * wide + symbol]``: the context one byte longer, or the node itself if it isn't in the tree.
        self.steps: list[np.ndarray] = []
        for d in range(1, order + 1):
            bytes_, number = grams[d]
            contexts, row = np.unique(bytes_[:, :-1], axis=0, return_inverse=True) if len(bytes_) else (np.zeros((0, d), np.uint8), np.zeros(0, int))
            row = row.ravel()
            shorter = np.array([place[c[1:].tobytes()] for c in contexts], np.int64).reshape(-1)
            before = [np.concatenate(x) for x in (lengths, escapes, seen_by)]
            hits = np.zeros((len(contexts), a + 1, langs), np.int32)
            hits[row, self.symbol[bytes_[:, -1]] if len(bytes_) else row] = number
            full, after = before[0][shorter], before[1][shorter]
            for c in range(langs):  # one language at a time: the steps between need room
                one = slice(c, c + 1)
                self._extend(hits[:, :, one], full[:, :, one], after[:, :, one], before[2][shorter, :, one])
            step = np.repeat(np.arange(total, dtype=np.int32), w).reshape(total, w)
            for k, c in enumerate(contexts):
                step[shorter[k], self.symbol[c[0]]] = total + k
                place[c.tobytes()] = total + k
            self.steps.append(step.ravel())
            # a context that a language hasn't met codes like the shorter one, and so do longer ones
            missing = hits.sum(axis=1, keepdims=True) == 0
            hits = np.where(missing, before[2][shorter], hits)
            lengths.append(full)
            if d < order:
                escapes.append(after), seen_by.append(hits)
            del before, hits, after, missing
            total += len(contexts)
        with np.errstate(divide="ignore"):
            self.lengths = (-np.log(np.concatenate(lengths))).reshape(-1, langs)

    @staticmethod
    def _grams(model: PpmCounts) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n = 1 to order + 1: all n-grams as rows of bytes, and their counts by language."""
        out, codes, counts = [], np.zeros(0, np.int64), np.zeros((0, len(model.languages)), np.int64)
        for n in range(model.order + 1, 0, -1):
            codes = np.concatenate([codes & ((1 << 8 * n) - 1), model.codes[n].astype(np.int64)])
            counts = np.concatenate([counts, model.counts[n]])
            codes, row = np.unique(codes, return_inverse=True)
            summed = np.zeros((len(codes), counts.shape[1]), np.int64)
            np.add.at(summed, row.ravel(), counts)
            counts = summed
            out.append((codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n :], counts))
        return out[::-1]

    @staticmethod
    def _fill(hits: np.ndarray, full: np.ndarray, after: np.ndarray, shorter: np.ndarray) -> None:
        """The distribution ``full`` of contexts from their counts and what follows their escape."""
        met = hits > 0
        sum_, kinds = hits.sum(axis=1, keepdims=True), met.sum(axis=1, keepdims=True)
        whole = np.maximum(sum_ + kinds, 1)
        escape = np.where(sum_ > 0, kinds / whole, 1.0)
        full[:] = np.where(met, hits / whole, escape * shorter)
        after[:] = shorter

    def _extend(self, hits: np.ndarray, full: np.ndarray, after: np.ndarray, shorter_hits: np.ndarray) -> None:
        """From the shorter contexts' ``full`` and ``after`` to those of contexts with counts ``hits``."""
        met = hits > 0
        left = np.where(met, 0, shorter_hits)
        sum_, kinds = left.sum(axis=1, keepdims=True), (left > 0).sum(axis=1, keepdims=True)
        whole = sum_ + kinds
        escape = np.where(whole > 0, kinds / np.maximum(whole, 1), 1.0)
        behind = np.where(left > 0, left / np.maximum(whole, 1), escape * after)
        new, new_after = np.empty_like(full), np.empty_like(after)
        self._fill(hits, new, new_after, behind)
        unmet = hits.sum(axis=1, keepdims=True) == 0
        full[:] = np.where(unmet, full, new)
        after[:] = np.where(unmet, after, new_after)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Nats of each text under each language; the texts lie end to end in ``data``."""
        out = np.zeros((len(offsets) - 1, self.lengths.shape[1]))
        starts = offsets[:-1][np.diff(offsets) > 0]
        for at in range(0, len(data), BYTES):
            end = min(len(data), at + BYTES)
            reach = max(0, at - len(self.steps))
            part = self.symbol[data[reach:end]]
            n, lead = end - at, at - reach
            node = np.zeros(n, np.int64)
            for d, step in enumerate(self.steps, 1):
                earlier = np.full(n, self.symbols + 1, np.int64)
                skip = max(0, d - lead)
                earlier[skip:] = part[lead + skip - d : lead + n - d]
                for k in range(d):  # these places have fewer than d bytes of their text before them
                    cold = starts + k - at
                    earlier[cold[(cold >= 0) & (cold < n)]] = self.symbols + 1
                node = step[node * self.wide + earlier]
            first = int(np.searchsorted(offsets, at, side="right")) - 1
            edges = starts[(starts > at) & (starts < end)]
            texts = np.append(first, np.searchsorted(offsets, edges, side="right") - 1)
            got = self.lengths[node.astype(np.int64) * (self.symbols + 1) + part[lead:]]
            np.add.at(out, texts, np.add.reduceat(got, np.append(0, edges - at), axis=0, dtype=np.float64))
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    code, row = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    number = np.zeros(len(code), np.int64)
    np.add.at(number, row.ravel(), np.concatenate([n for _, n in parts]))
    return code, number


def _gram_counts(order: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, language and length the n-grams and their counts, packed; texts shorter than a gram give what they have."""
    found: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    held: dict[tuple[str, int], int] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for lang, a, b in zip(langs, offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].astype(np.int64)
            code = np.zeros(len(text), np.int64)
            for k in range(order + 1):
                code[k:] |= text[: len(text) - k] << 8 * k
            grams = [(n, code[n - 1 : n]) for n in range(1, min(order, len(text)) + 1)] + [(order + 1, code[order:])]
            for n, codes in grams:
                parts = found.setdefault((lang, n), [])
                parts.append(np.unique(codes, return_counts=True))
                held[lang, n] = held.get((lang, n), 0) + len(parts[-1][0])
                if held[lang, n] > GRAMS_HELD:
                    parts[:] = [_merged(parts)]
                    held[lang, n] = 0  # what is left is bounded by the language's own grams
    for (lang, n), parts in found.items():
        code, number = _merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([n], pa.int32()), pa.array([code.astype("<u4").tobytes()], pa.binary()), pa.array([number.astype("<i8").tobytes()], pa.binary())],
            ["lang", "n", "codes", "numbers"],
        )


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, per_language: int = TEXTS_PER_LANGUAGE) -> PpmCounts:
    """Counts from at most ``per_language`` distinct texts of each language, chosen by a hash of the text.

    Rows with a null or empty text or a null language teach nothing.  The n-grams of the
    sample are counted in :data:`COUNTING_TASKS` tasks, whatever the number of partitions;
    the driver receives one packed row for each task, language and length.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be 1, 2 or 3")
    rows = labelled.select(labelled[lang_col].cast("string").alias("lang"), labelled[text_col].cast("string").alias("text")).where(
        "lang is not null and length(text) > 0"
    ).withColumn("hashed", F.xxhash64("text"))
    limits = lowest_hashes(rows, "lang", "hashed", per_language)
    sample = rows.where(within_limits(F.col("lang"), F.col("hashed"), limits))
    # a copied text counts once
    sample = sample.groupBy("lang", "hashed").agg(F.first("text").alias("text")).select("lang", "text")
    packed = sample.coalesce(COUNTING_TASKS).mapInArrow(tidy(lambda b: _gram_counts(order, b)), "lang string, n int, codes binary, numbers binary").collect()
    languages = tuple(sorted(limits))
    codes, counts = [np.zeros(0, np.int64)], [np.zeros((0, len(languages)), np.int64)]
    for size in range(1, order + 2):
        mine = [(languages.index(r["lang"]), np.frombuffer(r["codes"], "<u4").astype(np.int64), np.frombuffer(r["numbers"], "<i8")) for r in packed if r["n"] == size]
        unique = np.unique(np.concatenate([np.zeros(0, np.int64), *[c for _, c, _ in mine]]))
        table = np.zeros((len(unique), len(languages)), np.int64)
        for lang, code, number in mine:
            table[np.searchsorted(unique, code), lang] += number
        codes.append(unique), counts.append(table)
    return PpmCounts(languages, order, tuple(codes), tuple(counts))


def _scored(model: PpmCounts, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array(model.languages, object)
    for batch in batches:
        data, offsets = utf8(batch.column(batch.num_columns - 1))
        if len(names):
            nats = kept_in_worker(("ppm", key), lambda: PpmTable(model)).code_lengths(data, offsets)
            best = nats.argmin(axis=1)
            least = nats[np.arange(len(nats)), best]
            share = 1 / np.exp(least[:, None] - nats).sum(axis=1)
            lang = names[best]
        else:
            least, share, lang = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1), np.full(len(offsets) - 1, None)
        size = np.diff(offsets)
        bits = np.where(size > 0, least / np.log(2) / np.maximum(size, 1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(share), pa.array(bits)], [*batch.schema.names[:-1], "found", "share", "bits_per_byte"]
        )


def identify(documents: DataFrame, model: PpmCounts, id_col: str = "doc_id", text_col: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """Per row: ``doc_id``, ``lang_pred``, ``score``, ``bits_per_byte`` (and the ``carry`` columns after the id).

    ``lang_pred`` is the language of the shortest code (ties: the first by name), or
    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    ``score`` is that language's share of 2^-code length over all languages, from equal
    priors.  Whole texts are coded; other columns are not read.  A narrow pass: no shuffle.
    """
    kept = documents.select(documents[id_col].alias("doc_id"), *carry, documents[text_col].cast("string").alias("text"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = kept.select(*kept.columns[:-1], lettered.alias("lettered"), "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    key = model.key
    out = kept.mapInArrow(tidy(lambda b: _scored(model, key, b)), schema + ", found string, share double, bits_per_byte double")
    known = F.col("lettered") & F.col("found").isNotNull()
    return out.select(
        *out.columns[: len(kept.columns) - 2],
        F.when(known, F.col("found")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(known, F.col("share")).otherwise(F.lit(0.0)).alias("score"),
        "bits_per_byte",
    )
