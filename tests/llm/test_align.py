import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from helpers import AWKWARD, corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roleweave.llm import align

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
OURS = align.Aligner(A_PATH, B_PATH)


def plain_bytes(text):
    """Ids and bytes of each token of both, from the libraries alone."""
    table = align._byte_of()
    a = [(i, bytes(table[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("\u2581", " ").encode()) for i in B.encode(text) for p in [B.id_to_piece(i)]]
    return a, b


def plain(text):
    """Groups as written, and links, by byte positions."""
    if not text:
        return 0, 0, 0, "", []
    a, b = plain_bytes(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return 0, 0, 0, "", []
    spans = []
    for side in (a, b):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        spans.append(own)
    cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    groups, begin = [], 0
    for end in cuts:
        groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in spans))
        begin = end
    owner = [[i for i, (_, s, e) in enumerate(side) for _ in range(s, e)] for side in spans]
    links = [(spans[0][x][0], spans[1][y][0]) for x, y in sorted(set(zip(*owner)))]
    return len(a), len(b), len(groups), ";".join(groups), links


def by_brute_force(rows):
    found = [(r[0], plain(r[1])) for r in rows]
    count = Counter(p for _, f in found for p in f[4])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, f[0], f[1], f[2], len(f[4]), sum(count[p] == best[p[1]] for p in f[4]), sum(count[p] for p in f[4]), f[3]) for i, f in found), key=str)


TRICKY = [
    (1, "<|endoftext|> and <s> </s> <unk> <0x0A> are plain text", "x", "s"), (2, "a\u2581b has the mark itself", "x", "s"), (3, "日本語のテキスト 🙂🙂 ẍ", "x", "s"),
    (4, "  two  spaces\t\ttabs\r\n\n\nlines ", "x", "s"), (5, "\u0000 nul \u0085 \u00a0 \u2003 \u200b", "x", "s"), (6, "I'll we've 12345678 ½ ²", "x", "s"), (7, "ab" * 5000 + " " * 3000, "x", "s"),
]


def test_alignment_and_counts_are_those_by_byte_positions(spark, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_CHARS", 700)  # many blocks
    rows = corpus(60) + AWKWARD + TRICKY + [(8, "the same text again", "x", "s")] * 20
    got = align.align(documents(spark, rows), A_PATH, B_PATH).collect()
    assert sorted(map(tuple, got), key=str) == by_brute_force(rows)


def test_one_block_gives_the_same(spark):
    rows = corpus(20) + TRICKY[:3]
    got = align.align(documents(spark, rows, clashes=False).coalesce(1), A_PATH, B_PATH).collect()
    assert sorted(map(tuple, got), key=str) == by_brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (2, "", None, None)]])
def test_tables_without_tokens(spark, rows):
    got = align.align(documents(spark, rows), A_PATH, B_PATH).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i, *_ in rows]


@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
@settings(max_examples=400, deadline=None)
def test_latin_texts_get_the_ids_of_the_library(text):
    assert OURS.a.ranked is not None
    assert OURS.a.encode_all([text]) == [A.encode(text, add_special_tokens=False).ids]


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_any_text_is_aligned_as_by_byte_positions(text):
    n_a, n_b, n_groups, groups, pairs = OURS.align_all([text])[0]
    want = plain(text)
    assert (n_a, n_b, n_groups, groups) == want[:4]
    assert sorted(pairs.tolist()) == sorted(x * align.SECOND + y for x, y in want[4])


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60), st.integers(0, 2**32))
@settings(max_examples=300, deadline=None)
def test_links_are_the_overlaps(sizes, seed):
    rng = random.Random(seed)
    total = sum(sizes)
    a = sorted({total, *[e for e in range(1, total) if rng.random() < 0.7]})
    b = sorted({total, *[e for e in a if rng.random() < 0.9], *[e for e in range(1, total) if rng.random() < 0.1]})
    left, right = align.walk(a, b)
    owner = [[i for i, e in enumerate(side) for _ in range(side[i - 1] if i else 0, e)] for side in (a, b)]
    assert list(zip(left, right)) == sorted(set(zip(*owner)))


def test_a_long_one_to_one_stretch_is_few_comparisons():
    class Counted(list):
        slices = 0

        def __getitem__(self, k):
            Counted.slices += isinstance(k, slice)
            return super().__getitem__(k)

    ends = [*range(1, 100_001)]
    places = [*range(100_000)]
    assert align.walk(Counted(ends), ends) == (places, places)
    assert Counted.slices < 60
