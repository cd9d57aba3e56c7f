"""BPE encoding and decoding with segment trees over the ranks of adjacent pairs.

A piece of text is a row of symbols.  The leaves of its tree hold the merge rank of
each symbol and its right neighbour (infinite if that pair has no merge), inner nodes
the least rank below them, so the root is the lowest rank and a walk down to the left
finds its leftmost place.  A merge changes three leaves, each in logarithmic time, until
no pair can be merged.  The trees of all pieces of about one length are rows of one numpy
array, and each step takes every row's next merge at once.

Works for tokenizer files whose pre-tokenizer drops white space and whose words end in
a suffix; their normalizer and pre-tokenizer come from the tokenizers library, the
merges and the decoding are made here.  Words repeat, so a worker keeps a bounded table
of words met before; when it is full it starts anew, which costs time and no results.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from roleweave.llm.common import kept_in_worker, tidy

#: No merge for a pair: larger than any rank.
NONE = np.int32(2**31 - 1)
#: Trees are made for at most so many leaves at a time.
LEAVES = 1 << 20


class Merges:
    """The merge list: ranks by pair of symbols, the merged symbol by rank."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int], symbols: int):
        keys = np.array([a * symbols + b for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.symbols, self.keys, self.rank = symbols, np.append(keys[order], np.int64(-1)), np.append(order.astype(np.int32), NONE)
        self.merged = np.array(merged, np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where a side is -1 (no symbol) or the pair has no merge."""
        key = left.astype(np.int64) * self.symbols + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)


def _put(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray | np.int32) -> None:
    """Sets one leaf of each given tree and the least ranks above it."""
    tree[rows, leaf] = rank
    node = leaf >> 1
    while len(node) and node[0] >= 1:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node = node >> 1


def merge_rows(symbols: np.ndarray, merges: Merges) -> np.ndarray:
    """Rows of symbols (-1 after the end) after all merges; merged places are -1.

    Each round merges, in every row that still has one, the leftmost pair of lowest rank.
    """
    m, n = symbols.shape
    width = max(2, 1 << (n - 1).bit_length())
    # one more column: the place after the last, and, read as -1, the place before the first
    sym = np.full((m, n + 1), -1, np.int32)
    sym[:, :n] = symbols
    after = np.tile(np.arange(1, n + 2, dtype=np.int32).clip(max=n), (m, 1))
    before = np.tile(np.arange(-1, n, dtype=np.int32) % (n + 1), (m, 1)).astype(np.int32)
    tree = np.full((m, 2 * width), NONE, np.int32)
    tree[:, width : width + n - 1] = merges.ranks(sym[:, : n - 1], sym[:, 1:n])
    w = width
    while w > 1:
        tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
        w //= 2
    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        least = tree[rows, 1]
        node = np.ones(len(rows), np.int64)
        while node[0] < width:
            node *= 2
            node += tree[rows, node] != least
        i = node - width
        j = after[rows, i]
        k = after[rows, j]
        h = before[rows, i]
        new = merges.merged[least]
        sym[rows, i], sym[rows, j] = new, -1
        after[rows, i], before[rows, k] = k, i
        _put(tree, rows, j + width, NONE)
        _put(tree, rows, node, merges.ranks(new, sym[rows, k]))
        left = h < n
        _put(tree, rows[left], h[left] + width, merges.ranks(sym[rows, h], new)[left])
        rows = rows[tree[rows, 1] != NONE]
    return sym[:, :n]


def merge_all(pieces: list[list[int]], merges: Merges) -> list[bytes]:
    """Each piece's symbols after all merges, as little-endian unsigned 32-bit integers."""
    out = [b""] * len(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    classes = np.where(sizes > 1, np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), 0)
    for c in np.unique(classes):
        which, wide = np.flatnonzero(classes == c), 1 << int(c)
        step = max(1, LEAVES // wide)
        for at in range(0, len(which), step):
            part = which[at : at + step]
            flat = np.full((len(part), max(1, int(sizes[part].max()))), -1, np.int32)
            mask = np.arange(flat.shape[1]) < sizes[part][:, None]
            flat[mask] = np.fromiter(chain.from_iterable(pieces[x] for x in part), np.int32, int(sizes[part].sum()))
            done = merge_rows(flat, merges) if c else flat
            live = done >= 0
            ends = 4 * np.cumsum(live.sum(axis=1))
            ids = done[live].astype("<u4").tobytes()
            begin = 0
            for x, end in zip(part.tolist(), ends.tolist()):
                out[x] = ids[begin:end]
                begin = end
    return out


def _split_pattern(spec: dict):
    """The file's pattern, if it normalizes and splits as NFC, blanks, lower case, pattern, bytes; else None."""
    import regex

    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return None
    cut, to_bytes = parts
    if cut["behavior"] != "Removed" or not cut["invert"] or to_bytes["add_prefix_space"] or to_bytes["use_regex"]:
        return None
    return regex.compile(cut["pattern"]["Regex"])


class WordBpe:
    """One tokenizer file, ready to encode and decode whole texts."""

    def __init__(self, path: str, words_kept: int = 1 << 18, longest_kept: int = 48):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix")
        if model["type"] != "BPE" or not self.suffix or any(a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("needs a BPE file with a suffix at word ends and special tokens that aren't normalized")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(self.vocab[a], self.vocab[b]) for a, b in pairs], [self.vocab[a + b] for a, b in pairs], max(self.vocab.values()) + 1)
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        blanks = [c for c in map(chr, range(0x3100)) if c.isspace()]
        dropped = [c for c in blanks if not self.split(self.normalize(c))]
        #: White space for Python that the file keeps as text.
        self.odd = [c for c in blanks if c not in dropped]
        self.words = re.compile(f"[^{re.escape(''.join(dropped))}]+")
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[str, bytes] = {}
        self.pattern = _split_pattern(spec)
        #: How the pre-tokenizer writes the bytes of each character below U+0180.
        self.as_bytes = {i: got[0][0] for i in range(0x180) if (got := self.split(chr(i)))}
        self.words_kept, self.longest_kept = words_kept, longest_kept

    def pieces(self, part: str) -> list[str]:
        """The pre-tokenizer's pieces of a run without white space or special tokens.

        Plain Latin letters, digits and signs (below U+0180, where composition changes
        nothing) go through the file's own pattern; everything else through the library.
        """
        if self.pattern and (part.isascii() or max(part) < "\u0180" and "\u0130" not in part):
            found = [part.lower()] if part.isalpha() else self.pattern.findall(part.lower())
            return found if part.isascii() and part.isprintable() else [p.translate(self.as_bytes) for p in found]
        return [p for p, _ in self.split(self.normalize(part))]

    def symbols(self, piece: str) -> list[int]:
        return [*map(self.vocab.__getitem__, piece[:-1]), self.vocab[piece[-1] + self.suffix]]

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each run without white space, as little-endian unsigned 32-bit integers."""
        made: dict[str, list[str]] = {}
        for word in words:
            if self.specials and "<" in word:
                parts = [p for p in self.specials.split(word) if p]
                made[word] = list(chain.from_iterable([p] if p in self.special else self.pieces(p) for p in parts))
            else:
                made[word] = self.pieces(word)
        here = set(chain.from_iterable(made.values()))
        new = [*(here - self.known_pieces.keys())]
        if len(self.known_pieces) + len(new) > self.words_kept:
            self.known_pieces.clear()
            new = [*here]
        # a special token stands among the pieces as itself and is never merged
        ids = dict(zip(new, merge_all([[self.special[p]] if p in self.special else self.symbols(p) for p in new], self.merges)))
        self.known_pieces |= ids
        get = self.known_pieces.__getitem__
        out = {w: get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts)) for w, parts in made.items()}
        for p in ids:
            if len(p) > self.longest_kept:
                del self.known_pieces[p]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, joined like those of its words."""
        cut = [self.words.findall(t) if any(c in t for c in self.odd) else t.split() for t in texts]
        here = set(chain.from_iterable(cut))
        new = here - self.known.keys()
        if len(self.known) + len(new) > self.words_kept:
            self.known.clear()
            new = here
        fresh = self.learn(new)
        self.known |= {w: i for w, i in fresh.items() if len(w) <= self.longest_kept}
        known = self.known if len(fresh) == 0 or max(map(len, fresh)) <= self.longest_kept else self.known | fresh
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with a space between them (the file names no decoder)."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = kept_in_worker(("bpe", path), lambda: WordBpe(path))
    for batch in batches:
        ids = bpe.encode_all([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
            ["doc_id", "ids", "decoded"],
        )


def encode_and_decode(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit), ``decoded`` (the ids' text).

    Null text counts as empty and gives no ids and an empty decoded text.  Rows with a
    null id or a repeated id are coded like any other; columns besides id and text are
    not read, so their names can't clash.  One pass without a shuffle: a lost executor's
    share is coded again from its input.  ``tokenizer_path`` is read on each worker.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("string").alias("text")).mapInArrow(
        tidy(lambda batches: _coded(tokenizer_path, batches)), f"doc_id {kind}, ids binary, decoded string"
    )
