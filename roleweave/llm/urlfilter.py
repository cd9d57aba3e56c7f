"""URL filters with a bit-parallel wildcard automaton.

Glob rules are compiled into Shift-And masks: each pattern owns a run of bits in a row of
64-bit words, one bit for each of its symbols, so one step of shift, AND and OR moves all
patterns on by one byte of the URL.  ``*`` matches any run of bytes but ``/``, ``**`` any
run at all; a wildcard is a bit that stays set while its bytes go by and that passes
itself by without one.  All URLs of a batch are stepped together.

Host rules are globs too: a host and its subdomains, and a path that starts with the
rule's, are ``host/path**`` and ``*.host/path**`` over the canonical URL (lower-cased
host, then the path).  The longest rule that fits decides; a URL that none fits gets the
verdict of the longest glob that matches, and else ``allow``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import utf8

ALLOW, BLOCK = "allow", "block"
#: Fixed values of the contract: (verdict, host, path).
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
#: Where no rule fits: (verdict, glob over host and path).
GLOBS = (
    (BLOCK, "ads.**"), (BLOCK, "*.ads.**"), (BLOCK, "adserver.**"), (BLOCK, "**/login"), (BLOCK, "**/login/**"), (BLOCK, "**/cgi-bin/**"),
    (BLOCK, "**/wp-admin/**"), (BLOCK, "**.exe"), (BLOCK, "**.zip"), (BLOCK, "**.apk"), (ALLOW, "**/robots.txt"),
)
#: State words of one batch that are stepped together.
STATE_WORDS = 1 << 18
#: Wildcards of a pattern.
RUN, ANY = -1, -2


def parse_glob(glob: str) -> list[int]:
    """Symbols of a glob: bytes, RUN for ``*``, ANY for ``**``; wildcards side by side are one."""
    out: list[int] = []
    raw = glob.encode()
    i = 0
    while i < len(raw):
        if raw[i] != ord("*"):
            out.append(raw[i])
            i += 1
            continue
        j = i
        while j < len(raw) and raw[j] == ord("*"):
            j += 1
        out.append(ANY if j - i > 1 else RUN)
        i = j
    return out


@dataclass(frozen=True)
class Automaton:
    """Masks over words of 64 bits; bit k of a pattern's run is set once its first k symbols have matched."""

    words: int
    symbol: np.ndarray  # (256, words): bits entered from the bit before by this byte
    stay: np.ndarray  # (256, words): wildcard bits that survive this byte
    passed: np.ndarray  # (words,): bits of wildcards, entered without a byte
    start: np.ndarray  # (words,)
    accept: tuple[tuple[int, int], ...]  # word and bit of each pattern's end

    @staticmethod
    def of(patterns: Sequence[list[int]]) -> Automaton:
        bits = sum(len(p) + 1 for p in patterns)
        words = max(1, -(-bits // 64))
        symbol, stay = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        passed, start, accept, at = np.zeros(words, np.uint64), np.zeros(words, np.uint64), [], 0

        def put(mask: np.ndarray, k: int) -> None:
            mask[..., k // 64] |= np.uint64(1) << np.uint64(k % 64)

        for p in patterns:
            put(start, at)
            for k, s in enumerate(p, at + 1):
                if s >= 0:
                    put(symbol[s], k)
                else:
                    put(passed, k)
                    for b in range(256):
                        if s == ANY or b != ord("/"):
                            put(stay[b], k)
            at += len(p) + 1
            accept.append(((at - 1) // 64, (at - 1) % 64))
        return Automaton(words, symbol, stay, passed, start, tuple(accept))

    def _on(self, state: np.ndarray) -> np.ndarray:
        """All bits one place up, over the words' borders."""
        moved = state << np.uint64(1)
        moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return moved

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, patterns): whether a pattern matches a whole text."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.accept)), bool)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        step = max(1, STATE_WORDS // self.words)
        for at in range(0, n, step):
            rows = order[at : at + step]  # longest first, so those still going are the first ones
            begin, left = offsets[:-1][rows], size[rows]
            state = np.tile(self.start, (len(rows), 1))
            # parse_glob leaves no two wildcards side by side, so one pass takes all of them
            state |= self._on(state) & self.passed
            for k in range(int(left[0]) if len(left) else 0):
                live = int(np.searchsorted(-left, -k, side="left"))
                byte = data[begin[:live] + k]
                now = state[:live]
                now = (self._on(now) & self.symbol[byte]) | (now & self.stay[byte])
                now |= self._on(now) & self.passed
                state[:live] = now
            for j, (w, b) in enumerate(self.accept):
                out[rows, j] = (state[:, w] >> np.uint64(b)) & np.uint64(1) > 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _judged(automaton: Automaton, names: list[str], verdicts: list[str], rules: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    label = np.array([*names[:rules], *[None] * (len(names) - rules + 1)], object)
    verdict = np.array([*verdicts, ALLOW], object)
    glob = np.array([*[None] * rules, *names[rules:], None], object)
    # longest first, rules before globs; argmax then takes the deciding one, and the last column where there is none
    order = sorted(range(len(names)), key=lambda j: (j >= rules, -len(names[j].encode()), j))
    for batch in batches:
        data, offsets = utf8(batch.column(3))
        hit = automaton.matches(data, offsets).reshape(len(offsets) - 1, len(names), 2).any(axis=2)
        hit = np.column_stack([hit[:, order], np.ones(len(hit), bool)])
        chosen = np.array([*order, len(names)])[hit.argmax(axis=1)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(label[chosen], pa.string()), pa.array(verdict[chosen], pa.string()), pa.array(glob[chosen], pa.string())],
            ["page_id", "host", "path", "rule", "verdict", "glob"],
        )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``, ``glob`` (the one that decided, or null).

    A null URL, an empty one or one without ``://`` has an empty host and path, which
    no host rule fits; globs and the default still judge it.  Rules of one length are
    told apart by their order.  Repeated rows are judged alike; a narrow pass without
    a shuffle that reads the id and the URL only.
    """
    patterns: list[list[int]] = []  # two for each name: a host and its subdomains, or a glob twice
    for _, host, path in rules:
        if "*" in host + path:
            raise ValueError("a rule's host and path are plain text")
        patterns += [parse_glob(f"{host}{path}**"), parse_glob(f"*.{host}{path}**")]
    for _, glob in globs:
        patterns += [parse_glob(glob), parse_glob(glob)]
    automaton = Automaton.of(patterns)
    names = [f"{host}{path}" for _, host, path in rules] + [g for _, g in globs]
    verdicts = [v for v, _, _ in rules] + [v for v, _ in globs]
    url = pages[url_col].cast("string")
    kind = pages.schema[id_col].dataType.simpleString()
    return (
        pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("canonical", F.concat("host", "path"))
        .mapInArrow(lambda b: _judged(automaton, names, verdicts, len(rules), b), f"page_id {kind}, host string, path string, rule string, verdict string, glob string")
    )
