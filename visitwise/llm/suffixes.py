"""Suffix-array dedup: a common-prefix-aware distributed merge sort of suffix runs.

Every byte covered by a ``length``-byte string that also starts earlier is removed. Not every
suffix has to be sorted for that. Each string of that length has one anchor: the leftmost of
its ``gram``-byte substrings with the least hash, which equal strings have at the same place. So the
strings are sorted by their anchors' suffixes:

1. Anchors' gram hashes are counted over all documents. An anchor whose gram occurs once
   belongs to strings that occur once, and is left out; the others are routed to their runs.
2. A run is a hash-chosen set of documents of about ``run_bytes``. It sorts its anchors' keys (the
   text right of the anchor, then the text left of it, read backwards, both just as far as the anchor's
   strings reach), and cuts them by the gram's hash into front-coded pieces, one for each part.
3. A part merges its pieces with a loser tree. Each head carries the length of the prefix
   it shares with the last output, so known prefixes are never compared again. The common
   prefix lengths of the sorted suffixes then tell, exactly and for every distance between a string's
   start and its anchor, which strings are equal; all but the earliest are marked.
4. The marked stretches are taken out of the texts.

Equal keys of one run leave it once, so copies do not add up. Grams found more than ``hot_rows`` times
do not go to one part: their strings are dealt by a 128-bit hash of the string instead, each
string once per run, which spreads them whatever stands around the gram.

Defined results: a null text is empty; a null doc_id counts as smaller than any other; rows that
repeat id and text are one document and get equal results; of rows that share an id only, the one
with the smaller text hash comes first.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitwise.llm.common import table
from visitwise.llm.registry import query
from visitwise.llm.repetition import BASE, INVERSE, mix
from visitwise.sources.workspace import stage

NO_ID = -(2**63)
PAD = 0xFF  # never a byte of UTF-8
SUFFIXES, STRINGS, STRETCHES = 0, 1, 2
# Positions share a 64-bit word with the hash that picks anchors.
PLACE_BITS = 22


@dataclass(frozen=True)
class Settings:
    length: int = 100
    gram: int = 36
    run_bytes: int = 16 * 1024 * 1024
    hot_rows: int = 100_000
    seed: int = 29


class Anchors:
    """Rolling hashes and anchors of byte strings."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.codes = np.random.default_rng(settings.seed).integers(0, 1 << 63, (2, 256), dtype=np.uint64)
        self.up = np.zeros(0, dtype=np.uint64)
        self.down = self.up

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = np.full(n, BASE, dtype=np.uint64), np.full(n, INVERSE, dtype=np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)

    def hashes(self, raw: np.ndarray, size: int, family: int = 0) -> np.ndarray:
        """A hash of every ``size``-byte substring."""
        count = len(raw) - size + 1
        self._powers(len(raw))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.codes[family][raw] * self.down[: len(raw)], out=sums[1:])
        return mix((sums[size:] - sums[:count]) * self.up[:count])

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, first start, last start, gram hash) for the strings of ``raw``, in order."""
        length, gram = self.settings.length, self.settings.gram
        step = (1 << PLACE_BITS) - length
        parts = []
        for begin in range(0, max(0, len(raw) - length + 1), step):
            a, lo, hi, h = self._find(raw[begin : begin + step + length - 1])
            parts.append((a + begin, lo + begin, hi + begin, h))
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none.astype(np.uint64)
        return tuple(np.concatenate(column) for column in zip(*parts))

    def _find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes = self.hashes(raw, self.settings.gram)
        keep = np.uint64(((1 << 64) - 1) ^ ((1 << PLACE_BITS) - 1))
        least = (hashes & keep) | np.arange(len(hashes), dtype=np.uint64)
        width, reach = self.settings.length - self.settings.gram + 1, 1
        while reach < width:
            shift = min(reach, width - reach)
            least = np.minimum(least[:-shift], least[shift:])
            reach += shift
        anchor = (least & ~keep).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
        at = anchor[first]
        return at, first, last, hashes[at]


def keyed(docs: DataFrame) -> DataFrame:
    """doc, th (hash of the text), data (the bytes)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).alias("th"),
        F.encode(text, "UTF-8").alias("data"),
    )


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed piece; unpack() knows their kinds."""
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values()), 1)


SUFFIX_KINDS = {"doc": "<i8", "th": "<i8", "anchor": "<i8", "near": "u1", "far": "u1", "shared": "u1"}
STRING_KINDS = {"h1": "<u8", "h2": "<u8", "doc": "<i8", "th": "<i8", "start": "<i8"}
STRETCH_KINDS = {"doc": "<i8", "th": "<i8", "start": "<i8", "end": "<i8"}


def unpack(blob: bytes, n: int, kinds: dict[str, str]) -> tuple[dict[str, np.ndarray], bytes]:
    data, at, out = zlib.decompress(blob), 0, {}
    for name, kind in kinds.items():
        out[name] = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += n * np.dtype(kind).itemsize
    return out, data[at:]


def shared_prefixes(keys: np.ndarray) -> np.ndarray:
    """Length of the prefix each row of a byte matrix shares with the row before; 0 for the first."""
    out = np.zeros(len(keys), dtype=np.int64)
    for begin in range(1, len(keys), 65_536):
        part = keys[begin - 1 : begin + 65_536]
        differ = part[1:] != part[:-1]
        out[begin : begin + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), keys.shape[1])
    return out


def sorted_order(keys: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


class Run:
    """The documents of one run: their candidates as pieces for the parts."""

    def __init__(self, settings: Settings, parts: int):
        self.settings = settings
        self.parts = parts
        self.anchors = Anchors(settings)

    def pieces(self, docs: list[tuple[int, int, bytes]], grams: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
        """(part, kind, n, blob); ``grams`` are the repeated gram hashes of the run, some of them hot."""
        length = self.settings.length
        docs = sorted({(doc, th): data for doc, th, data in docs}.items())
        grams, hot = np.unique(grams), np.unique(hot)
        base, columns = 0, []
        for number, (_, data) in enumerate(docs):
            raw = np.frombuffer(data, dtype=np.uint8)
            at, first, last, gram = self.anchors.find(raw)
            columns.append((np.full(len(at), number), at + base, first + base, last + base, gram))
            base += len(raw)
        if not columns:
            return
        owner, at, first, last, gram = (np.concatenate(c) for c in zip(*columns))
        # One look-up for the whole run: the list of grams is long and each text is short.
        chosen = np.isin(gram, grams)
        owner, at, first, last, gram = owner[chosen], at[chosen], first[chosen], last[chosen], gram[chosen]
        raw = np.frombuffer(b"".join(data for _, data in docs), dtype=np.uint8)
        ids = np.array([key for key, _ in docs], dtype=np.int64).reshape(-1, 2)
        starts = np.concatenate([[0], np.cumsum([len(data) for _, data in docs])[:-1]]).astype(np.int64)
        is_hot = np.isin(gram, hot)
        marked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        cold = np.flatnonzero(~is_hot)
        if len(cold):
            keys = self.keys(raw, at[cold], first[cold], last[cold])
            order = sorted_order(keys)
            keys, cold = keys[order], cold[order]
            shared = shared_prefixes(keys)
            again = shared == keys.shape[1]
            again[0] = False
            marked.append((owner[cold[again]], first[cold[again]], last[cold[again]] + length))
            keys, cold = keys[~again], cold[~again]
            part = (gram[cold] % np.uint64(self.parts)).astype(np.int64)
            by_part = np.argsort(part, kind="stable")
            keys, cold, part = keys[by_part], cold[by_part], part[by_part]
            shared = shared_prefixes(keys)
            cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
            shared[cuts[:-1]] = 0
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = cold[a:b]
                tails = keys[a:b][np.arange(keys.shape[1])[None, :] >= shared[a:b, None]]
                yield int(part[a]), SUFFIXES, int(b - a), pack(
                    doc=ids[owner[some], 0],
                    th=ids[owner[some], 1],
                    anchor=at[some] - starts[owner[some]],
                    near=(at[some] - last[some]).astype(np.uint8),
                    far=(at[some] - first[some]).astype(np.uint8),
                    shared=shared[a:b].astype(np.uint8),
                    tails=tails,
                )
        warm = np.flatnonzero(is_hot)
        if len(warm):
            yield from self._strings(raw, ids, starts, owner[warm], first[warm], last[warm], marked)
        who, begin, end = (np.concatenate(c) for c in zip(*marked))
        who, begin, end = join_stretches(who, begin, end)
        if len(who):
            yield int(mix(np.array([abs(int(ids[0, 1]))], dtype=np.uint64))[0] % np.uint64(self.parts)), STRETCHES, len(who), pack(
                doc=ids[who, 0], th=ids[who, 1], start=begin - starts[who], end=end - starts[who]
            )

    def keys(self, raw: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Right and left contexts, filled up with PAD beyond what the anchor's strings reach."""
        length, back = self.settings.length, self.settings.length - self.settings.gram
        out = np.full((len(at), length + back), PAD, dtype=np.uint8)
        for begin in range(0, len(at), 65_536):
            rows = slice(begin, begin + 65_536)
            right = at[rows, None] + np.arange(length)
            inside = right < last[rows, None] + length
            out[rows, :length][inside] = raw[right[inside]]
            left = at[rows, None] - 1 - np.arange(back)
            inside = left >= first[rows, None]
            out[rows, length:][inside] = raw[left[inside]]
        return out

    def _strings(self, raw, ids, starts, owner, first, last, marked) -> Iterator[tuple]:
        """The strings of hot grams by their own hash, each distinct string once."""
        length = self.settings.length
        h1 = self.anchors.hashes(raw, length, 0)
        h2 = self.anchors.hashes(raw, length, 1)
        counts = last - first + 1
        place = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        owner = np.repeat(owner, counts)
        order = np.lexsort((place, h2[place], h1[place]))
        place, owner = place[order], owner[order]
        a, b = h1[place], h2[place]
        again = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        marked.append((owner[again], place[again], place[again] + length))
        place, owner, a, b = place[~again], owner[~again], a[~again], b[~again]
        part = (a % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for number in np.unique(part):
            some = order[cuts[number] : cuts[number + 1]]
            yield int(number), STRINGS, len(some), pack(
                h1=a[some], h2=b[some], doc=ids[owner[some], 0], th=ids[owner[some], 1], start=place[some] - starts[owner[some]]
            )


def join_stretches(who: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching stretches of one owner as one."""
    order = np.lexsort((end, begin, who))
    who, begin, end = who[order], begin[order], end[order]
    if not len(who):
        return who, begin, end
    # Owners are moved apart, so one running maximum serves all.
    room = int(end.max()) + 1
    far = np.maximum.accumulate(end + np.unique(who, return_inverse=True)[1].astype(np.int64) * room)
    near = begin + np.unique(who, return_inverse=True)[1].astype(np.int64) * room
    fresh = np.concatenate([[True], near[1:] > far[:-1]])
    heads = np.flatnonzero(fresh)
    tails = np.concatenate([heads[1:] - 1, [len(who) - 1]])
    shift = near[heads] - begin[heads]
    return who[heads], begin[heads], far[tails] - shift


def merge(keys: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs with a loser tree that knows common prefixes.

    ``shared`` has each key's common prefix length with the key before it in its run. Returns the run of each
    output, its number in the run, and its common prefix length with the output before.
    """
    size = 1
    while size < len(keys):
        size *= 2
    full = len(keys[0][0]) if keys and keys[0] else 0
    # known[r]: prefix that run r's head shares with the last output; -1 when the run is used up.
    heads: list[bytes | None] = [run[0] if run else None for run in keys] + [None] * (size - len(keys))
    known = [0 if head is not None else -1 for head in heads]
    place = [0] * size
    losers = [-1] * size

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser): the longer known prefix is the smaller key; equal ones are compared beyond it."""
        a, b = known[x], known[y]
        if a != b:
            return (x, y) if a > b else (y, x)
        if a < 0:
            return x, y
        left, right = heads[x][a:], heads[y][a:]
        if left == right:
            known[max(x, y)] = full
            return (x, y) if x < y else (y, x)
        bits = int.from_bytes(left, "big") ^ int.from_bytes(right, "big")
        common = a + len(left) - (bits.bit_length() + 7) // 8
        if left < right:
            known[y] = common
            return x, y
        known[x] = common
        return y, x

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        for i in range(level):
            winners[i], losers[level + i] = play(winners[2 * i], winners[2 * i + 1])
    best = winners[0]
    runs, numbers, prefixes = [], [], []
    while known[best] >= 0:
        at = place[best]
        runs.append(best)
        numbers.append(at)
        prefixes.append(known[best])
        at += 1
        place[best] = at
        if at < len(keys[best]):
            heads[best] = keys[best][at]
            known[best] = shared[best][at]
        else:
            heads[best] = None
            known[best] = -1
        node = (size + best) // 2
        while node:
            rival = losers[node]
            a, b = known[best], known[rival]
            if a < b or (a == b and a >= 0):
                best, losers[node] = play(best, rival)
            node //= 2
    return runs, numbers, prefixes


def decode_keys(shared: np.ndarray, tails: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for common in shared.tolist():
        rest = width - common
        last = last[:common] + tails[at : at + rest]
        at += rest
        out.append(last)
    return out


class Part:
    """What a part finds out from its pieces."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.back = settings.length - settings.gram
        self.width = settings.length + self.back

    def stretches(self, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        """(doc, th, start, end) to remove, from pieces (kind, n, blob)."""
        out = [self._suffixes([r for r in rows if r[0] == SUFFIXES]), self._strings([r for r in rows if r[0] == STRINGS])]
        for _, n, blob in (r for r in rows if r[0] == STRETCHES):
            found, _ = unpack(blob, n, STRETCH_KINDS)
            out.append(tuple(found[name] for name in STRETCH_KINDS))
        return tuple(np.concatenate(column) for column in zip(*out))

    def _suffixes(self, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, dtype=np.int64)
        if not rows:
            return none, none, none, none
        pieces, keys, shared = [], [], []
        for _, n, blob in rows:
            piece, tails = unpack(blob, n, SUFFIX_KINDS)
            pieces.append(piece)
            keys.append(decode_keys(piece["shared"], tails, self.width))
            shared.append(piece["shared"].tolist())
        runs, numbers, prefixes = merge(keys, shared)
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])[:-1]])
        order = offsets[np.array(runs)] + np.array(numbers)
        column = {name: np.concatenate([p[name] for p in pieces])[order].astype(np.int64) for name in SUFFIX_KINDS}
        prefix = np.array(prefixes)
        # Only suffixes that share a gram with a neighbour can hold a repeated string.
        joined = prefix >= self.settings.gram
        joined[0] = False
        alive = np.flatnonzero(joined | np.concatenate([joined[1:], [False]]))
        if not len(alive):
            return none, none, none, none
        left = b"".join(keys[r][i][self.settings.length :] for r, i in zip(np.array(runs)[alive].tolist(), np.array(numbers)[alive].tolist()))
        del keys
        left = np.frombuffer(left, dtype=np.uint8).reshape(-1, self.back)
        prefix = np.where(joined, prefix, 0)[alive]
        column = {name: values[alive] for name, values in column.items()}
        left_order = sorted_order(left)
        left_prefix = shared_prefixes(left[left_order])
        age = np.empty(len(alive), dtype=np.int64)
        age[np.lexsort((column["anchor"], column["th"], column["doc"]))] = np.arange(len(alive))
        least = np.full(len(alive), self.width, dtype=np.int64)
        most = np.full(len(alive), -1, dtype=np.int64)
        for distance in range(self.back + 1):
            some = np.flatnonzero((column["near"] <= distance) & (distance <= column["far"]))
            if len(some) < 2:
                continue
            # Equal right of the anchor and equal left of it: classes by common prefix length.
            right_class = np.cumsum(prefix < self.settings.length - distance)
            left_class = np.empty(len(alive), dtype=np.int64)
            left_class[left_order] = np.cumsum(left_prefix < distance) if distance else 0
            string = right_class[some] * (len(alive) + 1) + left_class[some]
            sequence = np.lexsort((age[some], string))
            later = some[sequence[1:][string[sequence][1:] == string[sequence][:-1]]]
            least[later] = np.minimum(least[later], distance)
            most[later] = np.maximum(most[later], distance)
        hit = most >= 0
        # One anchor's strings all overlap, so what is removed around it is one stretch.
        begin, end = column["anchor"] - most, column["anchor"] - least + self.settings.length
        return column["doc"][hit], column["th"][hit], begin[hit], end[hit]

    def _strings(self, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        none = np.zeros(0, dtype=np.int64)
        if not rows:
            return none, none, none, none
        pieces = [unpack(blob, n, STRING_KINDS)[0] for _, n, blob in rows]
        h1, h2, doc, th, start = (np.concatenate([p[name] for p in pieces]) for name in STRING_KINDS)
        order = np.lexsort((start, th, doc, h2, h1))
        h1, h2, doc, th, start = h1[order], h2[order], doc[order], th[order], start[order]
        again = np.concatenate([[False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])])
        return doc[again], th[again], start[again], start[again] + self.settings.length


def repeated_stretches(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc, th, start, end: stretches of bytes to remove; they may overlap."""
    ready = keyed(docs)
    total = ready.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    runs = max(1, math.ceil(total / settings.run_bytes))
    placed = ready.withColumn("run", F.pmod(F.xxhash64("doc", "th"), F.lit(runs)).cast("int"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(settings)
        for batch in batches:
            found, owner = [], []
            for run, data in zip(*batch.columns):
                gram = anchors.find(np.frombuffer(data.as_buffer(), dtype=np.uint8))[3]
                found.append(gram.view(np.int64))
                owner.append(np.full(len(gram), run.as_py(), dtype=np.int32))
            if not found:
                continue
            gram, run = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((run, gram))
            gram, run = gram[order], run[order]
            # Twice per run says as much as more often.
            third = np.zeros(len(gram), dtype=bool)
            third[2:] = (gram[2:] == gram[:-2]) & (run[2:] == run[:-2])
            yield pa.RecordBatch.from_arrays([pa.array(gram[~third]), pa.array(run[~third])], ["gram", "run"])

    counted = placed.select("run", "data").mapInArrow(grams, "gram bigint, run int")
    count = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    repeated = counted.withColumn("n", count).where("n > 1").select("run", "gram", (F.col("n") > settings.hot_rows).alias("hot"))

    def split(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(zip(*(left.column(c).to_pylist() for c in ("doc", "th", "data"))))
        gram, hot = right.column("gram").to_numpy().view(np.uint64), right.column("hot").to_numpy(zero_copy_only=False)
        found = list(Run(settings, runs).pieces(rows, gram, gram[hot.astype(bool)])) if len(gram) else []
        part, kind, n, blob = zip(*found) if found else ((), (), (), ())
        return pa.table(
            {
                "part": pa.array(part, pa.int32()),
                "kind": pa.array(kind, pa.int32()),
                "n": pa.array(n, pa.int32()),
                "blob": pa.array(blob, pa.binary()),
            }
        )

    def settle(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("kind", "n", "blob"))))
        return pa.table(dict(zip(STRETCH_KINDS, Part(settings).stretches(rows))))

    pieces = (
        placed.groupBy("run").cogroup(repeated.groupBy("run")).applyInArrow(split, "part int, kind int, n int, blob binary")
    )
    return pieces.groupBy("part").applyInArrow(settle, "doc bigint, th bigint, start bigint, end bigint")


def _cut(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc, th, data, stretches of the distinct (doc, th)."""
    found = repeated_stretches(docs, settings)
    found = stage(found, "stretches").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    return keyed(docs).join(found, ["doc", "th"], "left")


def kept_bytes(data: bytes, stretches: list[dict] | None) -> tuple[bytes, int]:
    """The bytes outside the stretches, and how many maximal stretches there are."""
    if not stretches:
        return data, 0
    begin = np.array([s["start"] for s in stretches])
    end = np.array([s["end"] for s in stretches])
    _, begin, end = join_stretches(np.zeros(len(begin), dtype=np.int64), begin, end)
    edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), len(begin)


def remove_repeated_bytes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lefts, spans = [], [], []
            for data, stretches in zip(batch.column(1), batch.column(2)):
                raw = data.as_py()
                left, n = kept_bytes(raw, stretches.as_py())
                sizes.append(len(raw))
                lefts.append(left)
                spans.append(n)
            removed = [size - len(left) for size, left in zip(sizes, lefts)]
            columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(lefts, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    return _cut(docs, settings).select(doc_id, "data", "stretches").mapInArrow(
        apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    )


@query("op10_suffixes")
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
