"""Quality rules from repetition: how much of a text lies in repeated n-grams and lines.

Each text is measured on its own in one narrow Arrow pass, so nothing is shuffled. Words
are numbered, numbers are mixed to 64 bits, and one prefix sum gives the rolling hash of
every n-gram of every length. Equal hashes are checked against the word numbers, so the
counts are exact.

Defined results: a null or empty text has zero counts and fails the base rule (fewer than
10 words). Repeated rows are measured once each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from visitwise.llm.common import table
from visitwise.llm.registry import query

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Limits:
    """Largest share of a text's word bytes inside n-grams seen earlier, by n, and in repeated lines."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.15), (7, 0.13), (10, 0.10))
    lines: float = 0.20
    min_words: int = 10
    max_repeat_percent: int = 20


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base & MASK, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finalizer over unsigned 64-bit values."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Hashes of all n-grams of one sequence of word numbers, for any n."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(mix(ids.astype(np.uint64)) * _power(INVERSE, len(ids)), out=self.sums[1:])

    def repeats(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of n-grams found twice or more, and of those found earlier already."""
        count = len(self.ids) - n + 1
        if count < 2:
            none = np.zeros(0, dtype=np.int64)
            return none, none
        hashes = (self.sums[n:] - self.sums[:-n]) * _power(BASE, count)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
        first, second = order[:-1][same], order[1:][same]
        if not all(np.array_equal(self.ids[first + j], self.ids[second + j]) for j in range(n)):
            grams = np.lib.stride_tricks.sliding_window_view(self.ids, n)
            _, group = np.unique(grams, axis=0, return_inverse=True)
            order = np.argsort(group, kind="stable")
            same = group[order][1:] == group[order][:-1]
            first, second = order[:-1][same], order[1:][same]
        return np.unique(np.concatenate([first, second])), second


def covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``length`` words lie in an n-gram that begins at one of the starts."""
    step = np.zeros(length + 1, dtype=np.int64)
    step[starts] += 1
    step[starts + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None, limits: Limits = Limits()) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares by n, line share)."""
    none = (0.0,) * len(limits.ngrams)
    if not text:
        return 0, 0, 0, 0, 0, none, 0.0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    solid = len(raw.translate(None, SPACES))
    word_chars = len(text) - (len(raw) - solid)
    seen: set[bytes] = set()
    dup_lines = dup_bytes = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_bytes += len(line.translate(None, SPACES))
        elif line.strip():
            seen.add(line)
    line_share = dup_bytes / solid if solid else 0.0
    if n_words <= WINDOW:
        return n_words, word_chars, n_symbols, dup_lines, 0, none, line_share
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n_words)
    rolling = RollingHash(ids)
    repeated, _ = rolling.repeats(WINDOW)
    n_repeat = int(covered(repeated, WINDOW, n_words).sum()) if len(repeated) else 0
    sizes, shares = None, []
    for n, _ in limits.ngrams:
        # A repeated longer n-gram holds a repeated shorter one.
        if n >= WINDOW and not n_repeat:
            shares.append(0.0)
            continue
        _, later = rolling.repeats(n)
        if sizes is None:
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
        shares.append(float(sizes[covered(later, n, n_words)].sum()) / solid if len(later) else 0.0)
    return n_words, word_chars, n_symbols, dup_lines, n_repeat, tuple(shares), line_share


def repetition_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: counts, shares, ``base_failed`` and ``kept``."""
    shares = [f"dup_{n}gram_share" for n, _ in limits.ngrams]
    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, kept boolean, "
        + ", ".join(f"{name} double" for name in shares)
        + ", dup_line_share double"
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                counts = measure(text.as_py(), limits)
                n_words, n_repeat, by_n, by_line = counts[0], counts[4], counts[5], counts[6]
                failed = n_words < limits.min_words or 100 * n_repeat > limits.max_repeat_percent * n_words
                kept = not failed and by_line <= limits.lines
                kept = kept and all(share <= most for share, (_, most) in zip(by_n, limits.ngrams))
                row = (doc_id.as_py(), *counts[:5], failed, kept, *by_n, by_line)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * (len(shares) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(judge, schema)


@query("op3_repetition")
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
