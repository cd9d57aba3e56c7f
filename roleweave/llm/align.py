"""Cross-tokenizer alignment by diagonal runs, and how often two tokens are linked corpus-wide.

Two tokenizers cut the same bytes.  Where tokens of both end at one byte, a group ends.
While the group is one token of each, the end arrays agree at a fixed index shift, so a run
of such groups is skipped by comparing stretches of the two arrays, of doubling length and
then of halving length at the run's end.  Elsewhere tokens are taken from whichever side
ends first until both end together, and the shift changes by the difference.

A pair of ids counts its links in all documents.  Documents are aligned in blocks of a
bounded number of characters; a block sends each of its distinct pairs once, and later asks for
the counts of those pairs only.  So no table of pairs is sent to every task, and rows
shuffled are the blocks' distinct pairs, not the documents'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.common import kept_in_worker, ready, saved

#: Characters of texts that end a block (so a longer text ends its own).
BLOCK_CHARS = 4 << 20
#: Id pairs as one number: first id times this, plus second id.
SECOND = 1 << 32


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Fixed values of that format: printable Latin-1 characters stand for themselves, the
    other bytes, ascending, for the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE file: ids of whole texts, and the bytes of each id.

    Texts of Latin letters only are encoded with the file's vocabulary as merge ranks
    (which ids of such files are: the constructor checks it), all others, and all texts of
    files for which that does not hold, by the tokenizers library.  Both give the same ids.
    """

    #: Characters below are cut into words alike by both libraries.
    LATIN = "ɐ"
    #: The pattern that cuts texts into words, a fixed value of the format.
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are plain text
        self.library.no_truncation()
        self.library.no_padding()
        byte = _byte_of()
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if token in special else bytes(map(byte.__getitem__, token))
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        made = [vocab[m] for m in merged]
        pre = spec.get("pre_tokenizer") or {}
        by_rank = made == [*range(256, 256 + len(made))] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and not spec.get("normalizer")
        ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
        self.ranked = tiktoken.Encoding("ranks of the file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if by_rank else None

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        rest = []
        for at, text in enumerate(texts):
            if self.ranked and (text.isascii() or max(text) < self.LATIN):
                out[at] = self.ranked.encode_ordinary(text)
            else:
                rest.append(at)
        for at in rest:
            out[at] = self.library.encode(texts[at], add_special_tokens=False).ids
        return out


class PieceBpe:
    """A sentencepiece file: ids of whole texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


def walk(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of each two tokens whose byte ranges overlap, by their ends ``a`` and ``b``.

    Both ascend to the same last end.  A group ends with each two that end together.
    """
    left: list[int] = []
    right: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        x, y = a[i], b[j]
        if x != y:
            # an irregular group: the side that ends first goes on; each step is an overlap
            while x != y:
                left.append(i)
                right.append(j)
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            left.append(i)
            right.append(j)
            i += 1
            j += 1
            continue
        shift, end, step = j - i, i + 1, 1
        last = min(n, m - shift)
        if end < last and a[end] == b[end + shift]:
            # probe along the diagonal: doubling while stretches agree, then halving
            while end + step <= last and a[end : end + step] == b[end + shift : end + shift + step]:
                end += step
                step *= 2
            while step := step >> 1:
                if end + step <= last and a[end : end + step] == b[end + shift : end + shift + step]:
                    end += step
            left += range(i, end)
            right += range(j, end + shift)
        else:  # one group stands alone
            left.append(i)
            right.append(j)
        i, j = end, end + shift
    return left, right


class Aligner:
    """Both tokenizers, and texts aligned by them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteBpe(a_path), PieceBpe(b_path)
        self.a_size, self.b_size = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        # ids as written within a group and as its last of either side
        self.a_name, self.b_name = (
            np.array([[f"{i}{sign}" for i in range(len(t.bytes))] for sign in signs], object) for t, signs in ((self.a, ",|"), (self.b, ",;"))
        )

    def align_all(self, texts: list[str | None]) -> list[tuple]:
        """Per text: ``(n_a, n_b, n_groups, groups, pairs)``; ``pairs`` are its links as id pairs, one number each."""
        out: list[tuple] = [(0, 0, 0, "", np.zeros(0, np.int64))] * len(texts)
        full = [k for k, t in enumerate(texts) if t]
        all_a = self.a.encode_all([" " + texts[k] for k in full])
        all_b = self.b.encode_all([texts[k] for k in full])
        for k, a, b in zip(full, all_a, all_b):
            whole = (" " + texts[k]).encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) == whole and b"".join(map(self.b.bytes.__getitem__, b)) == whole:
                out[k] = self.align(a, b)
        return out

    def align(self, a: list[int], b: list[int]) -> tuple:
        """The same for the ids of a text that is not empty and that both write whole."""
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        left, right = map(np.array, walk(a_end.tolist(), b_end.tolist()))
        ends = np.flatnonzero(a_end[left] == b_end[right])
        # a group is written as its ids of the first, then those of the second: every id
        # goes behind what the other side has in the groups before (for the second: and in its own)
        a_upto, b_upto = np.append(0, left[ends] + 1), np.append(0, right[ends] + 1)
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[left[ends]] = b_last[right[ends]] = 1
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + b_upto[np.cumsum(a_last) - a_last]] = self.a_name[a_last, a_ids]
        written[np.arange(len(b)) + a_upto[np.cumsum(b_last) - b_last + 1]] = self.b_name[b_last, b_ids]
        return len(a), len(b), len(ends), "".join(written.tolist())[:-1], a_ids[left] * SECOND + b_ids[right]


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts, as many as make a block."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if size >= BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _packed(ids: list, kind: pa.DataType, made: list[tuple]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A block's distinct pairs, their links in it, and its documents as compressed Arrow.

    A document holds the places of its distinct pairs among the block's, as differences.
    """
    own = [np.unique(m[4], return_counts=True) for m in made]
    keys, place = np.unique(np.concatenate([p for p, _ in own]), return_inverse=True)
    times = np.concatenate([c for _, c in own]).astype(np.int64)
    ends = np.cumsum([0, *(len(p) for p, _ in own)])
    apart = np.diff(place, prepend=0)
    first = ends[:-1][np.diff(ends) > 0]
    apart[first] = place[first]
    listed = lambda flat: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
    docs = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, kind), "n_a": [m[0] for m in made], "n_b": [m[1] for m in made], "n_groups": [m[2] for m in made], "n_links": [len(m[4]) for m in made],
        "groups": pa.array([m[3] for m in made], pa.large_string()), "places": listed(apart), "times": listed(times),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(docs)
    links = np.zeros(len(keys), np.int64)
    np.add.at(links, place, times)
    return keys, links, sink.getvalue().to_pybytes()


_RESULT = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _scored(kind: pa.DataType, blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """A block's documents with the counts that it asked for."""
    order = np.argsort(counted["pair"].to_numpy(), kind="stable")
    count, best = counted["count"].to_numpy()[order], counted["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    docs = pa.ipc.open_stream(blocks["documents"][0].as_py()).read_all()
    n_best, count_sum = [], []
    for places, times in zip(docs["places"], docs["times"]):
        at, n = np.cumsum(places.values.to_numpy(), dtype=np.int64), times.values.to_numpy()
        n_best.append(int(n @ best[at]))
        count_sum.append(int(n @ count[at]))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups", docs["groups"].cast(pa.string())).cast(pa.schema([
        ("doc_id", kind), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())]))


def blocks(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned documents in blocks: ``block, pairs, links, documents``, kept in the shared checkpoint folder.

    ``pairs`` are the block's distinct linked id pairs (first id times 2**32 plus second id),
    ``links`` their links in it, ``documents`` its documents as compressed Arrow.
    """
    ready(documents.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(documents.schema[id_col].dataType)

    def align(batches):
        from pyspark import TaskContext

        aligner = kept_in_worker(("align", a_path, b_path), lambda: Aligner(a_path, b_path))
        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_taken(batches)):
            keys, sums, packed = _packed(ids, kind, aligner.align_all(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part * SECOND + number]), pa.array([keys], pa.list_(pa.int64())), pa.array([sums], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                ["block", "pairs", "links", "documents"],
            )

    read = documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("string").alias("text"))
    return saved(read.mapInArrow(align, "block long, pairs array<long>, links array<long>, documents binary"))


def pair_counts(blocked: DataFrame) -> DataFrame:
    """``pair, count, best`` of every linked id pair of :func:`blocks`.

    ``best`` is whether no other pair of the same second id has a higher count.  A second
    id has at most as many pairs as the first tokenizer has ids, which bounds its window.
    """
    each = blocked.select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
    total = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("count"))
    second = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(SECOND - 1)))
    return total.withColumn("best", F.col("count") == F.max("count").over(second))


def align(documents: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``groups`` is written ``a1,a2|b1;a3|b2,b3``, ids in order.  A link is a pair of tokens
    whose byte ranges overlap; ``count_sum`` sums, over the document's links, the links that
    have the same two ids in all documents; ``n_best`` are its links of :func:`pair_counts`'
    ``best`` pairs (ties included).

    Null and empty texts, and texts whose tokens' bytes are not the text with a space before
    it, have no tokens: zeros and empty groups.  Rows of null or repeated ids are documents
    like any other, and copies count as often as they occur; columns besides id and text are
    not read; an empty table gives an empty result.  A pair occurs at most once a block, so
    no pair has more rows than there are blocks.  Both files are read on each worker.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    blocked = blocks(documents, a_path, b_path, id_col, text_col)
    asked = blocked.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(pair_counts(blocked), "pair")
    kind = documents.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)
    return blocked.select("block", "documents").groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(
        lambda left, right: _scored(arrow_kind, left, right), _RESULT.format(kind=kind.simpleString())
    )
