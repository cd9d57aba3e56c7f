"""Mixing sources to target weights with soft domain membership.

A classifier learned from a labelled table gives every document a posterior over
domains.  Document rates r >= 0 are fitted so that the expected tokens of each domain,
the sum of rate x tokens x posterior, match the targets: weighted least squares by
projected gradient, and of all rates that fit, those nearest to 1.  A rate is 1 less the
product of its document's posterior with one number for each domain, cut at its least
value, so it follows from the posterior and those numbers.  An iteration moves the
numbers along the domains' misses, scaled by the second moments of the rows that aren't
cut; it is one pass over a narrow table that returns sums for each domain, for several
lengths of the step at once.  It ends when the gradient vanishes; no table of rates is
rewritten.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm import subwords
from roleweave.llm.common import saved, tidy

#: The production mixture over the label table's domains: shares of the mixed tokens.
TARGETS = {"q1t0": 0.94, "q0t0": 0.04, "q1t1": 0.02}
#: The domain whose expected tokens stay as they are; it sets the size of the mixture.
ANCHOR = "q1t0"
ITERATIONS, TOLERANCE = 60, 1e-5
#: Lengths of a step tried in one pass, and the weight of the distance from rate 1 beside the misses.
LENGTHS, NEAR = 0.25 ** np.arange(10), 1e-6


@dataclass(frozen=True)
class Fit:
    """Fitted rates as ``steps`` (see :func:`_rates`), and how well they fit.

    Tokens by domain: ``wanted`` by the targets as given, ``aimed`` at, and ``achieved``.
    ``gradient`` is the largest component of the objective's gradient at the end, in
    shares of the mixture; the fit ``converged`` when it is within the tolerance.
    """

    domains: tuple
    steps: np.ndarray
    wanted: np.ndarray
    aimed: np.ndarray
    achieved: np.ndarray
    gradient: float
    converged: bool
    passes: int

    def report(self) -> list[dict]:
        """One row a domain; ``miss`` is what was achieved beyond the wanted tokens."""
        return [
            {"domain": d, "wanted": float(w), "aimed": float(a), "achieved": float(t), "miss": float(t - w)}
            for d, w, a, t in zip(self.domains, self.wanted, self.aimed, self.achieved)
        ]


def domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``mark_id``, ``domain`` (like ``q1t0``: quality and toxic) of rows that have both labels."""
    return labels.select(
        labels[id_col].alias("mark_id"), F.concat(F.lit("q"), labels["quality"].cast("string"), F.lit("t"), labels["toxic"].cast("string")).alias("domain")
    ).where("domain is not null").distinct()


def train(documents: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = subwords.TEXTS_PER_CLASS) -> subwords.SubwordModel:
    """The domain classifier, from at most ``per_class`` distinct texts of each domain."""
    return subwords.train(documents, marks.select("mark_id", marks["domain"].alias("label")), id_col, text_col, per_class)


def _least(shares: np.ndarray, kept: int | None) -> np.ndarray | float:
    """Least rate of each document: 1 where domain ``kept`` is the likeliest (ties: the first), else 0."""
    return 0.0 if kept is None else (shares.argmax(axis=1) == kept).astype(float)


def _rates(shares: np.ndarray, steps: np.ndarray, kept: int | None = None) -> np.ndarray:
    """Rates of documents with these posteriors after the given steps."""
    rate, least = np.ones(len(shares)), _least(shares, kept)
    for step in steps:
        rate = np.maximum(least, rate - shares @ step)
    return rate


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(trials: np.ndarray, kept: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One table a task: for each trial the expected tokens by domain, the second moments of the
    rows that aren't cut, and the distance from rate 1 with the linear term; then all rows'
    tokens by likeliest domain and domain, and their second moments."""
    k = trials.shape[1]
    value, rest = np.zeros((len(trials), k + k * k + 1)), np.zeros((2, k, k))
    for batch in batches:
        shares, tokens = _matrix(batch.column(1), k), batch.column(0).to_numpy(zero_copy_only=False).astype(float)
        heavy, least = shares * tokens[:, None], _least(shares, kept)
        np.add.at(rest[0], shares.argmax(axis=1), heavy)
        rest[1] += heavy.T @ shares
        for out, trial in zip(value, trials):
            along = shares @ trial
            rate = np.maximum(least, 1 - along)
            free = 1 - along > least
            out[:k] += rate @ heavy
            out[k:-1] += (heavy[free].T @ shares[free]).ravel()
            out[-1] += tokens @ ((rate - 1) ** 2 / 2 + along * rate)
    value = np.concatenate([value.ravel(), rest.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], ["place", "value"])


def _within_reach(by_class: np.ndarray, want: np.ndarray, given: np.ndarray, kept: int | None) -> np.ndarray:
    """Totals that one rate for each class of documents gives, as near to ``want`` as can be.

    ``by_class[c, d]`` are the tokens of domain ``d`` in documents likeliest of ``c``.  A
    class without a target gets rate 0, so its domain is left with what the others'
    posteriors hold of it; the kept class gets 1 at least.
    """
    k = len(want)
    fit = by_class[:, given] / np.maximum(by_class.sum(axis=0)[given], 1e-300)
    goal = want[given] / np.maximum(by_class.sum(axis=0)[given], 1e-300)
    least = np.array([1.0 if c == kept else 0.0 for c in range(k)])
    rate = np.where(given, 1.0, least)
    square = (fit**2).sum(axis=1)
    for _ in range(5000):  # one rate at a time: a convex problem of a few numbers
        before = rate.copy()
        for c in np.flatnonzero(given & (square > 0)):
            rate[c] = max(least[c], rate[c] + fit[c] @ (goal - rate @ fit) / square[c])
        if np.abs(rate - before).max() < 1e-13:
            break
    return rate @ by_class


def fit(
    soft: DataFrame, domains: tuple, targets: dict, anchor: str | None = None, iterations: int = ITERATIONS, tolerance: float = TOLERANCE,
    reachable: bool = False, keep_anchor: bool = False,
) -> Fit:
    """Rates whose domain totals match, with the totals they reach.

    ``targets`` are shares; a domain without one gets 0.  The mixture is as large as the
    anchor's share needs for its total to stay, or as the whole input without an anchor.
    With ``reachable`` a domain without a target is aimed at what documents of the other
    domains hold of it, since no posterior is 0, and targets that one rate a class can't
    meet at the nearest totals that it can.  With ``keep_anchor`` documents that are
    likeliest of the anchor keep a rate of 1 or more.  Ends when the gradient of every
    domain is within ``tolerance`` of the mixture's size, or after ``iterations``.
    """
    k = len(domains)

    def gather(trials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = k + k * k + 1
        value = np.zeros(len(trials) * wide + 2 * k * k)
        rows = soft.select("n_words", "shares").mapInArrow(tidy(lambda b: _sums(trials, kept, b)), "place int, value double")
        for r in rows.groupBy("place").agg(F.sum("value").alias("value")).collect():
            value[r["place"]] = r["value"]
        return value[: len(trials) * wide].reshape(-1, wide), value[len(trials) * wide :].reshape(2, k, k)

    want = np.array([float(targets.get(d, 0.0)) for d in domains])
    at = domains.index(anchor) if anchor in domains and want[domains.index(anchor)] > 0 else None
    kept = at if keep_anchor else None
    got, (by_class, moment) = gather(np.zeros((1, k)))
    total = by_class.sum(axis=0)
    if not total.sum() or not want.sum():
        return Fit(domains, np.zeros((0, k)), total, total, total, 0.0, True, 1)
    given = want > 0
    want = want / want.sum()
    size = total[at] / want[at] if at is not None else total.sum()
    want = want * size
    aim = want
    if reachable:
        near = _within_reach(by_class, want, given, kept)
        aim = np.where(given, want, near) if np.abs(near - want)[given].max() <= tolerance * size else near
    # domains of any size weigh alike
    weight = NEAR * np.maximum(np.diag(moment), 1e-12 * moment.max())
    y, now, passes = np.zeros(k), got[0], 1

    def gradient(at_y: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return sums[:k] - aim - weight * at_y

    def height(at_y: np.ndarray, sums: np.ndarray) -> float:
        return float(sums[-1] - at_y @ aim - at_y @ (weight * at_y) / 2)

    while np.abs(gradient(y, now)).max() > tolerance * size and passes < iterations:
        step = np.linalg.solve(now[k:-1].reshape(k, k) + np.diag(weight), gradient(y, now))
        trials = y + LENGTHS[:, None] * step
        got, _ = gather(trials)
        passes += 1
        best = int(np.argmax([height(t, g) for t, g in zip(trials, got)]))
        if height(trials[best], got[best]) <= height(y, now):
            break  # as far as the numbers' precision goes
        y, now = trials[best], got[best]
    most = float(np.abs(gradient(y, now)).max() / size)
    return Fit(domains, np.round(y, 9)[None, :], want, aim, now[:k], most, most <= tolerance, passes)


def fit_rates(soft: DataFrame, domains: tuple, targets: dict, anchor: str | None = None, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The steps of :func:`fit`, from rate 1 to rates whose domain totals match the targets as given."""
    return fit(soft, domains, targets, anchor, iterations, tolerance).steps


def _with_rates(steps: np.ndarray, k: int, kept: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rate = _rates(_matrix(batch.column(batch.num_columns - 1), k), steps, kept)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(rate, 6))], [*batch.schema.names, "rate"])


def mix(
    documents: DataFrame, model: subwords.SubwordModel, targets: dict, anchor: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    iterations: int = ITERATIONS, carry: tuple[Column, ...] = (),
) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, the ``carry`` columns, ``n_words``, ``domain``, ``shares``, ``rate``, ``copies``.

    ``domain`` is the likeliest one (ties: the first by name), ``rate`` the fitted rate, at
    least 1 where ``domain`` is the anchor, so that only the other domains are thinned,
    ``copies`` how often the row goes into the mixture: the rate's whole part, and one
    more with the rest as its chance, drawn from a hash of id and text, so equal rows
    draw alike and every run draws the same.  Tokens are runs without white space; a row
    without any (null or empty text) adds nothing to the totals and has a rate like any
    other.  If fewer than two domains were learned, every rate is 1.
    """
    k = len(model.classes)
    text = documents[text_col].cast("string")
    own = (documents[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    soft = subwords.posteriors(documents, model, own, text_col)
    # carried columns are too wide to keep or to join: their rows are scored once more in passing
    full = (lambda **step: subwords.posteriors(documents, model, (*own, *carry), text_col, **step)) if carry else None
    carried = full().columns[2:-2] if carry else []
    if k < 2:
        return (full() if carry else soft).select("doc_id", "text_hash", *carried, "n_words", F.lit(model.classes[0] if k else None).cast("string").alias("domain"), "shares", F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    soft = saved(soft)
    found = fit(soft, model.classes, targets, anchor, iterations, reachable=True, keep_anchor=True)
    logging.getLogger(__name__).log(
        logging.INFO if found.converged else logging.WARNING, "mixture %s after %d passes, gradient %.1e: %s",
        "converged" if found.converged else "not converged", found.passes, found.gradient, found.report(),
    )
    steps, kept = found.steps, model.classes.index(anchor) if anchor in model.classes and targets.get(anchor, 0) > 0 else None
    def add_rates(batches):
        return _with_rates(steps, k, kept, batches)

    if carry:
        rated = full(then=add_rates, more=", rate double")
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in soft.schema.fields)
        rated = soft.mapInArrow(tidy(add_rates), f"{schema}, rate double")
    names = F.array(*[F.lit(c) for c in model.classes])
    best = F.element_at(names, F.array_position("shares", F.array_max("shares")).cast("int"))
    draw = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rated.select("doc_id", "text_hash", *carried, "n_words", best.alias("domain"), "shares", "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"))
