"""A linear softmax over averaged subword embeddings, trained jointly in numpy.

A word is a bag of the character n-grams of ``<word>`` and of the word itself, each
hashed to a bucket with an embedding.  A word's vector is the mean of its buckets', a
text's the mean of its words', and a softmax over a linear map of it gives the classes.
Embeddings and map are trained together.  After training each bucket has one number for
each class, so a text's scores are means over means, and a word's numbers are computed
once a worker.  Misspellings share n-grams with the words they come from.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import kept_in_worker, lowest_hashes, tidy, within_limits

#: Buckets, n-gram lengths, embedding size.
BUCKETS, SHORTEST, LONGEST, SIZE = 1 << 17, 3, 5, 8
#: Distinct training texts of each class at most: the bound on what is learned from.
TEXTS_PER_CLASS = 3000
STEPS, BATCH, RATE, SCALE, DECAY, SEED = 250, 128, 0.2, 60.0, 1e-5, 7
#: An odd multiplier of the rolling hash.
BASE = np.uint64(0x100000001B3)
#: Words whose numbers a worker keeps.
WORDS_KEPT = 1 << 17
#: Words whose n-grams are hashed at a time.
WORDS_AT_ONCE = 1 << 15
#: Bytes of text cut into words at a time, words of a text summed at a time, and how many such pieces together.
BYTES_AT_ONCE, PIECE, PIECES_AT_ONCE = 1 << 22, 1 << 12, 1 << 7


def word_of(raw: str) -> str:
    """A run without white space, lower-cased, without what isn't letter or digit at its ends; may be empty."""
    if raw.isalnum():
        return raw.lower()
    low = raw.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    return low[a:b]


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of ``<word>`` and of each whole word, in two arrays.

    N-grams of code points are hashed for all words at once; those over a word's end are left out.
    """
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = (np.arange(len(points)) - np.repeat(starts, size)).astype(np.uint64)
    power = np.ones(int(size.max()) if len(size) else 1, np.uint64)
    np.multiply.accumulate(np.append(power[:1], np.full(len(power) - 1, BASE)), out=power)
    whole = np.add.reduceat((points + np.uint64(1)) * power[place], starts) if len(words) else points
    found_word, found = [np.arange(len(words))], [whole]
    code = points + np.uint64(1)
    for n in range(2, LONGEST + 1):
        code = code[:-1] * BASE + points[n - 1 :] + np.uint64(1) if len(points) >= n else points[:0]
        if n >= SHORTEST:
            inside = owner[: len(code)] == owner[n - 1 : n - 1 + len(code)]
            found_word.append(owner[: len(code)][inside])
            found.append(code[inside] + np.uint64(n))
    mixed = np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate(found_word), ((mixed ^ (mixed >> np.uint64(29))) * BASE >> np.uint64(40)).astype(np.int64) % BUCKETS


@dataclass(frozen=True)
class SubwordModel:
    """``weights`` (buckets, classes) and ``bias`` (classes): what averaging leaves of the embeddings and the map."""

    classes: tuple
    weights: np.ndarray
    bias: np.ndarray

    @property
    def key(self) -> str:
        return hashlib.sha256(repr(self.classes).encode() + self.weights.tobytes() + self.bias.tobytes()).hexdigest()


class Scorer:
    """Scores texts with a model; remembers words."""

    def __init__(self, model: SubwordModel):
        self.model, self.known, self.rows = model, {}, np.zeros((0, len(model.classes) + 1))

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Each run's class numbers and a 1; zeros where it holds no letter or digit."""
        clean = [word_of(w) for w in words]
        some = np.flatnonzero(np.fromiter(map(bool, clean), bool, len(clean)))
        k = len(self.model.classes)
        out = np.zeros((len(words), k + 1))
        out[some, k] = 1
        for at in range(0, len(some), WORDS_AT_ONCE):
            part = some[at : at + WORDS_AT_ONCE]
            word, bucket = buckets_of([clean[i] for i in part.tolist()])
            number = np.bincount(word, minlength=len(part))
            for c in range(k):
                out[part, c] = np.bincount(word, self.model.weights[bucket, c], len(part)) / number
        return out

    def _places(self, words: list[str]) -> np.ndarray:
        """The rows of these distinct words, new ones added; a full cache starts anew."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known, self.rows, new = {}, self.rows[:0], words
        if new:
            self.known |= {w: i for i, w in enumerate(new, len(self.rows))}
            self.rows = np.concatenate([self.rows, self._numbers(new)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, classes) logits and the number of words of each text; a text without words has the bias.

        A batch's words are told apart once, by Arrow; the numbers of all words are gathered
        and summed for pieces of a text, so a text's sum doesn't depend on the texts beside it.
        """
        n, k = len(texts), len(self.model.classes)
        sums, number = np.zeros((n, k + 1)), np.zeros(n, np.int64)
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:  # as many texts as fit in so many bytes, one at least
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_AT_ONCE, side="right")))
            cut = pc.utf8_split_whitespace(texts.slice(at, end - at))
            coded = cut.flatten().dictionary_encode()
            place = self._places(coded.dictionary.to_pylist())
            word = coded.indices.to_numpy(zero_copy_only=False)
            words = np.diff(cut.offsets.to_numpy(zero_copy_only=False))
            blank = coded.dictionary.index("").as_py()
            number[at:end] = words - (np.bincount(np.repeat(np.arange(end - at), words)[word == blank], minlength=end - at) if blank >= 0 else 0)
            pieces = -(-words // PIECE)
            owner = np.repeat(np.arange(end - at), pieces)
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.append(np.repeat(np.cumsum(words) - words, pieces) + rank * PIECE, len(word))
            for first in range(0, len(owner), PIECES_AT_ONCE):
                last = min(first + PIECES_AT_ONCE, len(owner))
                got = self.rows[place[word[start[first] : start[last]]]]
                np.add.at(sums, at + owner[first:last], np.add.reduceat(got, start[first:last] - start[first], axis=0))
            at = end
        return self.model.bias + sums[:, :k] / np.maximum(sums[:, k:], 1), number

    def logits(self, texts: list[str]) -> np.ndarray:
        """(texts, classes) of a list of texts."""
        return self.score(pa.array(texts, pa.string()))[0]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: Iterable[tuple[str, object]], priors: dict | None = None) -> SubwordModel:
    """Trains embeddings and softmax together, with Adagrad on the averaged cross-entropy, from (text, label) pairs.

    Texts are read once, one at a time; the numbers of their words stay.  Classes weigh
    alike in training; ``priors`` (label to share) moves the bias to the shares that
    classes have where the model is used.
    """
    vocab: dict[str, int] = {}
    ids, counts, labels = [], [], []
    for t, label in rows:
        labels.append(label)
        words = [w for r in t.split() if (w := word_of(r))]
        found, number = np.unique(np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int32), return_counts=True)
        ids.append(found), counts.append((number / max(1, len(words))).astype(np.float32))
    classes = tuple(sorted(set(labels)))
    k = len(classes)
    if k < 2:
        return SubwordModel(classes, np.zeros((BUCKETS, k), np.float32), np.zeros(k))
    y = np.array([classes.index(x) for x in labels])
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    # the buckets of all words, word by word, a bounded number of words at a time
    listed, parts, sub_sizes = [*vocab], [], []
    del vocab
    for at in range(0, len(listed), WORDS_AT_ONCE):
        owner, bucket = buckets_of(listed[at : at + WORDS_AT_ONCE])
        parts.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        sub_sizes.append(np.bincount(owner, minlength=len(listed[at : at + WORDS_AT_ONCE])).astype(np.int32))
    sub = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    sub_size = np.concatenate(sub_sizes).astype(np.int64) if parts else np.zeros(0, np.int64)
    del listed, parts, sub_sizes
    # only buckets met in training have embeddings
    met = np.zeros(BUCKETS, bool)
    met[sub] = True
    used = np.flatnonzero(met)
    sub = (np.cumsum(met, dtype=np.int32) - 1)[sub]
    sub_at = np.cumsum(sub_size) - sub_size
    rng = np.random.default_rng(SEED)
    emb, emb_sum = np.zeros((len(used), SIZE)), np.full((len(used), SIZE), 1e-8)
    lin, lin_sum = rng.normal(0, 1 / np.sqrt(SIZE), (SIZE, k)), np.full((SIZE, k), 1e-8)
    bias, bias_sum = np.zeros(k), np.full(k, 1e-8)
    weight = 1 / np.bincount(y, minlength=k)[y]
    weight *= len(y) / weight.sum()

    def spread(values: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        return np.column_stack([np.bincount(index, values[:, d], n) for d in range(values.shape[1])])

    queue = np.zeros(0, np.int64)
    for _ in range(STEPS):
        if len(queue) < min(BATCH, len(y)):
            queue = np.concatenate([queue, rng.permutation(len(y))])
        part, queue = queue[:BATCH], queue[BATCH:]
        doc = np.repeat(np.arange(len(part)), sizes[part])
        if not len(doc):
            continue
        word, row = np.unique(np.concatenate([ids[i] for i in part]), return_inverse=True)
        share = np.concatenate([counts[i] for i in part])[:, None]
        size = sub_size[word]
        starts = np.cumsum(size) - size
        flat = sub[np.repeat(sub_at[word] - starts, size) + np.arange(int(size.sum()))]
        vec = np.add.reduceat(emb[flat], starts, axis=0) / size[:, None]
        mean = spread(vec[row] * share, doc, len(part))
        p = softmax(SCALE * (mean @ lin) + bias)
        p[np.arange(len(part)), y[part]] -= 1
        p *= weight[part][:, None] / len(part)
        g_lin, g_bias, g_mean = SCALE * mean.T @ p, p.sum(axis=0), SCALE * p @ lin.T
        g_vec = spread(g_mean[doc] * share, row, len(word)) / size[:, None]
        g_emb = spread(np.repeat(g_vec, size, axis=0), flat, len(used)) + DECAY * emb
        emb_sum += g_emb**2
        emb -= RATE * g_emb / np.sqrt(emb_sum)
        lin_sum += g_lin**2
        lin -= RATE * g_lin / np.sqrt(lin_sum)
        bias_sum += g_bias**2
        bias -= RATE * g_bias / np.sqrt(bias_sum)
    if priors:
        bias = bias + np.log([max(priors.get(c, 0), 1e-9) * k for c in classes])
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = SCALE * emb @ lin
    return SubwordModel(classes, weights, bias)


def _fitted(priors: dict | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_in_worker(("fit",), lambda: None)  # whatever this worker kept goes first
    model = fit(((t.as_py(), x.as_py()) for b in batches for t, x in zip(b.column("text"), b.column("label"))), priors)
    numbers = [pa.array([x.tobytes()], pa.binary()) for x in (model.weights, np.asarray(model.bias, np.float64))]
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model.classes)]), *numbers], ["classes", "weights", "bias"])


def train(
    documents: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = TEXTS_PER_CLASS, use_priors: bool = True
) -> SubwordModel:
    """Fits on at most ``per_class`` distinct texts of each label, chosen by a hash of the text.

    ``marks`` holds ``mark_id`` and ``label``; documents without a mark, and null texts or
    labels, teach nothing.  Ids and hashes are joined and ranked first; only the sample's
    texts are read after that, by a broadcast of its ids, which ``per_class`` bounds.  One
    task fits the sample, whole texts, and is repeated if its executor is lost; the driver
    receives the model.
    """
    rows = documents.select(documents[id_col].alias("row_id"), documents[text_col].cast("string").alias("text")).where("text is not null")
    rows = rows.withColumn("hashed", F.xxhash64("text"))
    marked = rows.select("row_id", "hashed").join(marks.where("label is not null"), F.col("row_id") == F.col("mark_id")).select("row_id", "hashed", "label")
    limits = lowest_hashes(marked, "label", "hashed", per_class)
    chosen = marked.where(within_limits(F.col("label"), F.col("hashed"), limits)).groupBy("label", "hashed").agg(F.min("row_id").alias("row_id"))
    sample = rows.join(F.broadcast(chosen), ["row_id", "hashed"]).groupBy("label", "hashed").agg(F.first("text").alias("text"))
    share = {r[0]: r[1] for r in marked.groupBy("label").count().collect()} if use_priors else {}
    total = sum(share.values())
    priors = {c: n / total for c, n in share.items()} if total else None
    sorted_sample = sample.repartition(1).sortWithinPartitions("label", "hashed").select("text", "label")
    got = sorted_sample.mapInArrow(tidy(lambda b: _fitted(priors, b)), "classes string, weights binary, bias binary").first()
    classes = tuple(json.loads(got["classes"])) if got else ()
    shape = (BUCKETS, len(classes))
    weights = np.frombuffer(bytes(got["weights"]), np.float32).reshape(shape) if got else np.zeros(shape, np.float32)
    return SubwordModel(classes, weights, np.frombuffer(bytes(got["bias"])) if got else np.zeros(0))


def _scored(model: SubwordModel, key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scorer = kept_in_worker(("subwords", key), lambda: Scorer(model))
    k = len(model.classes)
    for batch in batches:
        got, number = scorer.score(batch.column(batch.num_columns - 1).fill_null(""))
        p = softmax(got) if k else got
        shares = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * k), pa.array(p.ravel()))
        words = pa.array(number)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], words, shares], [*batch.schema.names[:-1], "n_words", "shares"])


def posteriors(documents: DataFrame, model: SubwordModel, keep: tuple[Column, ...], text_col: str = "text", then=None, more: str = "") -> DataFrame:
    """The ``keep`` columns, ``n_words`` and ``shares`` (an array: the probability of each of ``model.classes``) of every row.

    ``then``, a step from these batches to batches with the columns ``more`` added, runs in
    the same worker.
    """
    rows = documents.select(*keep, documents[text_col].cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    key = model.key
    then = then or (lambda b: b)
    return rows.mapInArrow(tidy(lambda b: then(_scored(model, key, b))), f"{schema}, n_words bigint, shares array<double>{more}")
