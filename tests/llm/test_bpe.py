import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import AWKWARD, corpus, documents
from roleweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBpe(PATH, words_kept=40, longest_kept=6)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(ours, library, texts):
    for text, ids in zip(texts, ours.encode_all(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:50]
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_like_the_library(ours, library):
    same(ours, library, [t for _, t, _, _ in corpus()])
    same(ours, library, ["", " ", "İstanbul ΣΑΣ ΟΔΟΣ", "x<|endoftext|>y <|startoftext|>", "don't I'll 123", "\x1c a\x85b\xa0c", "é ́a Å", "日本語 🙂👍🏽", "a" * 5000,
                          "ab" * 3000 + "!?" * 99, "\x00\x01", "<|ENDOFTEXT|> <|endoftext", "'S 'LL '", "x_y __ a_1", "ﬀ ẞ ſ", "ª º ² ½"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(ours, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    same(ours, library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=70), min_size=1, max_size=6))
def test_trees_merge_the_leftmost_lowest_pair(pieces):
    pairs = [(0, 0), (1, 2), (4, 0), (0, 1), (5, 3), (4, 4)]
    merges = bpe.Merges(pairs, list(range(4, 4 + len(pairs))), 10)
    rank = {p: i for i, p in enumerate(pairs)}

    def slow(s):
        s = list(s)
        while found := [(rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]:
            r, i = min(found)
            s[i : i + 2] = [4 + r]
        return s

    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_all(pieces, merges)] == [slow(p) for p in pieces]


def test_table(spark, library):
    rows = corpus(9) + AWKWARD
    got = bpe.encode_and_decode(documents(spark, rows), PATH).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "ids", "decoded"]
    key = lambda d, i: (d is None, d or 0, hashlib.sha256(i).hexdigest())
    want = [(r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in rows]
    assert sorted(key(r.doc_id, bytes(r.ids)) for r in got) == sorted(key(*w) for w in want)
    assert bpe.encode_and_decode(documents(spark, []), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises((ValueError, KeyError)):
        bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
