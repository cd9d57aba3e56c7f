import numpy as np

from helpers import AWKWARD, corpus, documents
from roleweave.llm import mixing
from roleweave.session import checkpoint_dir


def soft(spark, rows):
    return spark.createDataFrame(rows, "n_words long, shares array<double>")


def totals(rows, steps):
    rate = mixing._rates(np.array([s for _, s in rows]), steps)
    return (rate * np.array([n for n, _ in rows])) @ np.array([s for _, s in rows]), rate


def test_targets_are_met(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(5, 90)), rng.dirichlet([0.3, 0.3, 0.2]).tolist()) for _ in range(300)]
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    steps = mixing.fit_rates(soft(spark, rows), ("a", "b", "c"), targets)
    got, rate = totals(rows, steps)
    assert np.abs(got / got.sum() - [0.5, 0.3, 0.2]).max() < 1e-3 and rate.min() >= 0
    assert abs(got.sum() / sum(n for n, _ in rows) - 1) < 1e-3
    anchored, _ = totals(rows, mixing.fit_rates(soft(spark, rows), ("a", "b", "c"), targets, anchor="b"))
    assert abs(anchored[1] / (np.array([s for _, s in rows])[:, 1] @ np.array([n for n, _ in rows])) - 1) < 1e-3


def test_projection_keeps_rates_nonnegative(spark):
    rows = [(10, [1.0, 0.0]), (10, [0.0, 1.0]), (10, [0.5, 0.5])]
    steps = mixing.fit_rates(soft(spark, rows), ("a", "b"), {"a": 1.0})
    got, rate = totals(rows, steps)
    assert rate.min() == 0.0 and rate[1] == 0.0 and got[1] < 0.35 * got[0]
    # the optimum of the weighted squares over r >= 0, by fine search over the two free rates
    w = 1 / np.diag(sum(n * np.outer(s, s) for n, s in rows))
    cost = lambda a, c: w @ ((a * np.array([10, 0]) + c * np.array([5, 5]) - [30, 0]) ** 2)
    best = min(cost(a, c) for a in np.linspace(0, 4, 161) for c in np.linspace(0, 3, 121))
    assert cost(rate[0], rate[2]) <= best * 1.02 + 1e-6


def test_no_tokens_and_no_target(spark):
    assert len(mixing.fit_rates(soft(spark, [(0, [0.5, 0.5])]), ("a", "b"), {"a": 1.0})) == 0
    assert len(mixing.fit_rates(soft(spark, [(4, [0.5, 0.5])]), ("a", "b"), {"z": 1.0})) == 0


def test_mix(spark):
    checkpoint_dir(spark)
    rows = corpus(60) + AWKWARD
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 1)) for i in range(40)] + [(41, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = mixing.train(docs, mixing.domains(labels))
    assert model.classes == ("q0t0", "q0t1", "q1t0")
    got = mixing.mix(docs, model, {"q1t0": 0.6, "q0t0": 0.2, "q0t1": 0.2}).collect()
    assert len(got) == len(rows)
    right = {0: "q1t0", 1: "q0t1", 2: "q0t0"}
    held = [r for r in got if r.doc_id is not None and 40 <= r.doc_id < 60]
    assert sum(r.domain == right[r.doc_id % 3] for r in held) >= 18
    want = {"q1t0": 0.6, "q0t0": 0.2, "q0t1": 0.2}
    sums = np.sum([np.array(r.shares) * r.n_words * r.rate for r in got], axis=0)
    assert all(abs(s / sums.sum() - want[c]) < 0.01 for s, c in zip(sums, model.classes))
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert len({r.copies for r in got if r.doc_id == 904}) == 1
    none = mixing.mix(docs, mixing.train(docs, mixing.domains(labels.where("false"))), {"a": 1.0}).collect()
    assert {r.copies for r in none} == {1} and len(none) == len(rows)
    assert mixing.mix(documents(spark, []), model, {"q1t0": 1.0}).count() == 0


def sharp(n=400, seed=5):
    """Posteriors of a good classifier over four domains with the label table's shares."""
    rng = np.random.default_rng(seed)
    logits = rng.normal(0, 1, (n, 4)) + 5 * np.eye(4)[rng.choice(4, n, p=[0.126, 0.017, 0.761, 0.096])]
    shares = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    return [(int(rng.integers(5, 900)), s.tolist()) for s in shares]


def test_fit_converges_and_reports(spark):
    names = ("q0t0", "q0t1", "q1t0", "q1t1")
    found = mixing.fit(soft(spark, sharp()), names, mixing.TARGETS, mixing.ANCHOR, reachable=True)
    assert found.converged and found.passes < 30 and found.gradient <= mixing.TOLERANCE
    got, _ = totals(sharp(), found.steps)
    rows = {r["domain"]: r for r in found.report()}
    assert np.allclose([rows[d]["achieved"] for d in names], got, rtol=1e-6)
    size = sum(rows[d]["wanted"] for d in names)
    assert all(abs(rows[d]["achieved"] - rows[d]["aimed"]) <= 2 * mixing.TOLERANCE * size for d in names)
    assert rows["q0t1"]["wanted"] == 0 < rows["q0t1"]["aimed"]  # no posterior is 0
    assert not mixing.fit(soft(spark, sharp()), names, mixing.TARGETS, mixing.ANCHOR, iterations=1).converged


def test_likely_anchor_documents_are_never_dropped(spark):
    rng = np.random.default_rng(8)
    rows = corpus(60) + [(100 + i, f"{corpus(60)[i][1]} {corpus(60)[i + 1][1]}", "aa", "s") for i in rng.permutation(50).tolist()]  # posteriors between domains
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 1)) for i in range(40)], "doc_id long, quality int, toxic int")
    model = mixing.train(docs, mixing.domains(labels))
    got = mixing.mix(docs, model, {"q1t0": 0.9, "q0t0": 0.1}, "q1t0").collect()
    clean = [r for r in got if r.domain == "q1t0"]
    assert len(got) == len(rows) and clean and all(r.rate >= 1 and r.copies >= 1 for r in clean)
    assert any(max(r.shares) < 0.9 for r in clean)
    assert sum(r.n_words * r.rate for r in got if r.domain != "q1t0") < 0.5 * sum(r.n_words for r in got if r.domain != "q1t0")
