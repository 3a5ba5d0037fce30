"""Substring dedup over whole texts: MinHash banding of paragraphs, exact Jaccard, removal by components.

A paragraph here is a run of some ten words that ends where a hash of its last two words says so
(``least`` to ``most`` words), whatever the line breaks: every word of a text lies in one, and a passage has
the same paragraphs wherever it stands, but for its two ends. A-Z are compared in lower case.

1. One pass over the texts gives each paragraph's ``bands`` keys, each the least of its shingle hashes in another
   order, and the leading half of its digest; words become numbers once, and cuts, digests, shingles and keys are
   array operations over many texts. Two paragraphs of similarity 0.8 miss each other with a chance of 0.2 ** bands. Rows
   are added up per key with a map-side combine: how many paragraphs, and the least and greatest digest.
2. Keys with one digest and several paragraphs are exact repeats; those with several digests are candidates to verify.
   Both go to the second pass as bit filters that grow with them, and the second pass emits those paragraphs only:
   their places, and for candidates the keys and shingles.
3. Candidates meet by key and one of their rarest shingles, of which similar ones share one (``prefix_keys``), and the
   exact Jaccard similarity decides. By the key alone all would meet in which one common phrase stands next to other
   words, and the comparisons would grow with the square of the texts. Pairs that are connected already are skipped, so
   m similar ones cost about m comparisons. Groups above ``block`` members are cut into blocks, every
   pair of which is one task, so no group is gathered whole and none is capped.
4. Components of the links, with equal paragraphs as one node, are the classes. Of each class the first paragraph by
   (doc_id, place) stays, and the others leave their texts.

What a bit filter lets through by chance has no partner and changes nothing.

Defined results: null and empty texts, and rows without an id, stay as they are; repeated rows (equal id and
text) are one document and get equal results; a last paragraph of less than ``least`` words stays; extra columns
are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.llm import words
from visitwise.llm.common import map_batches, table
from visitwise.llm.components import components
from visitwise.llm.paragraphs import bit_filter, cut_words, similar
from visitwise.llm.registry import query
from visitwise.llm.repetition import mix
from visitwise.operators.names import fresh
from visitwise.sources.workspace import stage


@dataclass(frozen=True)
class Settings:
    least: int = 6
    cut: int = 6
    most: int = 40
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 4
    block: int = 2000
    seed: int = 3
    memo_words: int = 300_000
    # Texts are taken together until they have so many words.
    block_words: int = 200_000
    # Filters of at least 2 ** filter_bits bits (16 MB each) are sent to the tasks.
    filter_bits: int = 27


class Codes(dict):
    """64-bit hashes of words, each found once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@dataclass
class Units:
    """Paragraphs of a block of texts: text number, first word in it, words, two halves of the digest, band keys."""

    text: np.ndarray
    word: np.ndarray
    words: np.ndarray
    h: np.ndarray
    g: np.ndarray
    keys: np.ndarray
    shingles: np.ndarray
    starts: np.ndarray


class Cutter:
    def __init__(self, settings: Settings):
        self.settings = settings
        self.known = Codes()
        rng = np.random.default_rng(settings.seed)
        # Word positions weigh by odd numbers in either half of a digest; odd factors give other orders of hashes.
        self.weights = rng.integers(0, 1 << 63, (2, settings.most), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = rng.integers(0, 1 << 63, settings.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, settings.bands, dtype=np.uint64)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[int, Units]]:
        """(number of the first text, paragraphs) of runs of texts."""
        raw, ends = words.utf8(texts)
        first = begin = 0
        while first < len(ends):
            # Some six bytes a word.
            last = int(np.searchsorted(ends, begin + 6 * self.settings.block_words)) + 1
            held = ends[first:last]
            yield first, self.units(*self.codes(raw[begin : held[-1]], held - begin))
            first, begin = last, held[-1]

    def codes(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the number of words of each text."""
        if len(self.known) > self.settings.memo_words:
            self.known.clear()
        first, lengths, sizes = words.places(raw, ends)
        return words.xxh64(words.lowered(raw), first, lengths, self.known.__getitem__), sizes

    def bounds(self, codes: np.ndarray, sizes: np.ndarray) -> list[int]:
        """Ends of the runs that every text is cut into."""
        s = self.settings
        total = len(codes)
        marks = np.flatnonzero(mix(codes[1:] ^ mix(codes[:-1])) % np.uint64(s.cut) == 0) + 2
        # Where a run ends that begins at a word: at the first mark that leaves it long enough, but within its text.
        marked = np.repeat(np.append(marks, total), np.diff(marks, prepend=-1, append=total))
        ends = np.repeat(np.cumsum(sizes), sizes)
        early = ends[: max(0, total + 1 - s.least)]
        np.minimum(early, marked[s.least :], out=early)
        following = memoryview(np.minimum(ends, np.arange(s.most, total + s.most)))
        out, begin = [], 0
        while begin < total:
            begin = following[begin]
            out.append(begin)
        return out

    def units(self, codes: np.ndarray, sizes: np.ndarray) -> Units:
        """The paragraphs of at least ``least`` words."""
        s = self.settings
        stops = np.array(self.bounds(codes, sizes), dtype=np.int64)
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if len(stops) else stops
        lengths = stops - starts
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, starts, side="right")
        halves = []
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        mixed = mix(codes)
        for weights in self.weights:
            sums = np.add.reduceat(mixed * weights[place], starts) if len(starts) else codes
            halves.append(mix(sums + lengths.astype(np.uint64)))
        whole = np.flatnonzero(lengths >= s.least)
        text, starts, lengths = text[whole], starts[whole], lengths[whole]
        h, g = halves[0][whole], halves[1][whole]
        count = max(0, len(codes) - s.shingle + 1)
        shingles = np.zeros(count, dtype=np.uint64)
        for j in range(s.shingle):
            shingles = mix(shingles ^ codes[j : j + count])
        keys = np.empty((len(whole), s.bands), dtype=np.uint64)
        if len(whole):
            # A paragraph's shingles lie between its start and the last place where one fits.
            spans = np.stack([starts, starts + lengths - s.shingle + 1], axis=1).ravel()
            order = np.zeros(count + 1, dtype=np.uint64)
            for k, (factor, shift) in enumerate(zip(self.factors, self.shifts)):
                np.multiply(shingles, factor, out=order[:-1])
                order[:-1] += shift
                keys[:, k] = mix(np.minimum.reduceat(order, spans)[::2] ^ mix(np.array([k + 1], dtype=np.uint64)))
        return Units(text, starts - (ends - sizes)[text], lengths, h, g, keys, shingles, starts)

    def shingle_sets(self, units: Units, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles of some paragraphs, sorted in each, and their numbers."""
        owner, at = _spread(units.starts[which], units.words[which] - self.settings.shingle + 1)
        values = units.shingles[at]
        values = values[np.lexsort((values, owner))]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        return values[new], np.bincount(owner[new], minlength=len(which))

    def shingle_set(self, units: Units, i: int) -> np.ndarray:
        return np.unique(units.shingles[units.starts[i] : units.starts[i] + units.words[i] - self.settings.shingle + 1])


def _keyed(docs: DataFrame) -> DataFrame:
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select("doc_id", F.xxhash64("text").alias("th"), "text")


def band_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, h, n: band keys of the paragraphs, once per digest and block of texts, with their number."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(settings)
        for batch in batches:
            for _, units in cutter.blocks(batch.column(0)):
                h, at, n = np.unique(units.h, return_index=True, return_counts=True)
                columns = [
                    pa.array(units.keys[at].ravel().view(np.int64)),
                    pa.array(np.repeat(h.view(np.int64), settings.bands)),
                    pa.array(np.repeat(n, settings.bands)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "h", "n"])

    # A repeated row is one document, so its paragraphs are no repeats; later steps see to that.
    return map_batches(_keyed(docs).select("text"), apply, "key bigint, h bigint, n bigint")


def shared_keys(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, low, high: keys of two or more paragraphs, with their least and greatest digest."""
    keys = band_rows(docs, settings).groupBy("key").agg(
        F.sum("n").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")
    )
    return keys.where("n > 1").select("key", "low", "high")


PLACES = "doc_id bigint, th bigint, word int, words int, pid binary, keys array<bigint>, shingles binary"


class Marks:
    """A bit filter of 64-bit values that looks at two bits of each.

    It has 16 bits a value, 2 ** ``least_bits`` at least and 2 ** 30 (128 MB) at most, so that few others are let through.
    """

    def __init__(self, wanted: DataFrame, column: str, count: int, least_bits: int):
        self.bits = min(30, max(least_bits, (16 * count).bit_length()))
        both = F.explode(F.array(F.col(column), F.shiftrightunsigned(F.col(column), 34)))
        self.map = bit_filter(wanted.select(both.alias(column)), column, self.bits)

    def has(self, values: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << self.bits) - 1)
        found = self._bit(values & low)
        some = np.nonzero(found)
        found[some] = self._bit((values[some] >> np.uint64(34)) & low)
        return found

    def _bit(self, slots: np.ndarray) -> np.ndarray:
        return (self.map[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _binary(values: np.ndarray, sizes: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """Runs of ``sizes`` bytes of the values as binary cells; null where ``none`` says so (of size 0)."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    valid = None if none is None else pa.array(~none).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(offsets), pa.py_buffer(values)])


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the run, and the places, of all members of runs that have a first place and a size."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def repeated_units(docs: DataFrame, shared: DataFrame, settings: Settings) -> DataFrame:
    """Places of the paragraphs that share a key; keys and shingles of those that share it with another digest.

    A task gives keys and shingles with the first of equal paragraphs, and again when it has met very many others.
    """
    context = docs.sparkSession.sparkContext
    alike = F.col("low") == F.col("high")
    n_equal, n_mixed = shared.agg(F.count_if(alike), F.count_if(~alike)).first()
    # An equal paragraph's keys mostly all have its digest.
    equal = shared.where(alike).select("low")
    equal = context.broadcast(Marks(equal, "low", -(-n_equal // settings.bands), settings.filter_bits))
    mixed = context.broadcast(Marks(shared.where(~alike).select("key"), "key", n_mixed, settings.filter_bits))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(settings)
        names = [field.split()[0] for field in PLACES.split(", ")]
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, units in cutter.blocks(batch.column(2)):
                in_mixed = mixed.value.has(units.keys)
                some = in_mixed.any(axis=1)
                out = np.flatnonzero(some | equal.value.has(units.h))
                if not len(out):
                    continue
                pids = np.stack([units.h[out], units.g[out]], axis=1).byteswap()
                if len(seen) > settings.memo_words:
                    seen.clear()
                full = some[out]
                for i in np.flatnonzero(full).tolist():
                    pid = (int(units.h[out[i]]), int(units.g[out[i]]))
                    full[i] = pid not in seen
                    seen.add(pid)
                sizes = np.where(full, in_mixed[out].sum(axis=1), 0)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                keys = pa.array(units.keys[out][in_mixed[out] & full[:, None]].view(np.int64))
                values, counts = cutter.shingle_sets(units, out[full])
                bytes_of = np.zeros(len(out), dtype=np.int64)
                bytes_of[full] = 8 * counts
                at = first + units.text[out]
                columns = [
                    pa.array(ids[at]),
                    pa.array(hashes[at]),
                    pa.array(units.word[out].astype(np.int32)),
                    pa.array(units.words[out].astype(np.int32)),
                    _binary(pids, np.full(len(out), 16)),
                    pa.ListArray.from_arrays(offsets, keys, mask=pa.array(~full)),
                    _binary(values, bytes_of, ~full),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(_keyed(docs), apply, PLACES)


# Slots in which shingles are counted. They are in the order of their counts, so more slots would order them better.
SLOTS = 1 << 20
# Counts below this in one task are left out.
RARE = 16


def _flat(shingles: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of binary cells, and their number in each."""
    _, offsets, values = shingles.cast(pa.binary()).buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[shingles.offset :][: len(shingles) + 1]
    return np.frombuffer(values, dtype=np.uint64, offset=bounds[0], count=(bounds[-1] - bounds[0]) // 8), np.diff(bounds) // 8


def shingle_weights(sets: DataFrame) -> np.ndarray:
    """The logarithm of the number of sets that have a shingle, by its slot; 0 for rare ones. It only sets an order."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            if len(batch):
                table += np.bincount((_flat(batch.column(0))[0] & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        often = np.flatnonzero(table >= RARE)
        yield pa.RecordBatch.from_arrays([pa.array(often), pa.array(table[often])], ["slot", "n"])

    found = map_batches(sets.select("shingles"), counted, "slot bigint, n bigint")
    sums = found.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.uint8)
    out[sums["slot"].to_numpy()] = np.frexp(sums["n"].to_numpy().astype(np.float64))[1]
    return out


def prefix_keys(sets: DataFrame, settings: Settings) -> DataFrame:
    """key, pid: each key of a set with each of its rarest shingles, as many as two similar sets can't both miss.

    Of two sets of similarity s or more either has at least the share s of its n shingles in common with the other. So
    in any fixed order of all shingles they share one of the first n - ceil(s n) + 1. With the rarest ones first, sets
    that share a key through words that stand in very many texts meet only if they share a rarer shingle too.
    """
    weights = sets.sparkSession.sparkContext.broadcast(shingle_weights(sets))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            held = batch.column(1)
            keys = held.flatten().to_numpy().view(np.uint64)
            n_keys = held.value_lengths().to_numpy().astype(np.int64)
            values, sizes = _flat(batch.column(2))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            values = values[np.lexsort((values, weights.value[values & np.uint64(SLOTS - 1)], owner))]
            least = np.ceil(settings.similarity * sizes - 1e-6).astype(np.int64)
            prefix = sizes - least + 1
            # Row by row: which key of the set with which of its first shingles.
            row = np.repeat(np.arange(len(sizes)), n_keys * prefix)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n_keys * prefix) - n_keys * prefix, n_keys * prefix)
            key = keys[(np.cumsum(n_keys) - n_keys)[row] + place // prefix[row]]
            shingle = values[(np.cumsum(sizes) - sizes)[row] + place % prefix[row]]
            both = mix(key ^ mix(shingle)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both), batch.column(0).take(pa.array(row))], ["key", "pid"])

    return map_batches(sets.select("pid", "keys", "shingles"), apply, "key bigint, pid binary")


def candidate_groups(sets: DataFrame, settings: Settings) -> DataFrame:
    """key, i, j, pid: the members of each key of two or more, keys with the same members once.

    Members of a key above ``block`` are dealt over blocks; i and j name the two blocks that meet.
    """
    members = prefix_keys(sets, settings)
    sizes = members.groupBy(F.col("key").alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.bit_xor(F.xxhash64("pid")).alias("_x"),
        F.bit_xor(F.xxhash64("pid", F.lit(1))).alias("_y"),
    )
    chosen = sizes.where("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("_key").alias("_key"))
    parts = F.ceil(F.col("_n") / settings.block).cast("int")
    dealt = members.join(chosen.select("_key", "_n"), F.col("key") == F.col("_key")).withColumns(
        {"_own": F.pmod(F.xxhash64("pid"), parts).cast("int"), "_other": F.explode(F.sequence(F.lit(0), parts - 1))}
    )
    return dealt.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "pid")


def unit_links(units: DataFrame, settings: Settings) -> DataFrame:
    """a, b (digests): links enough to connect every class of near-equal paragraphs.

    Groups lie one behind the other in sorted partitions and are compared as they stream by, one at a time.
    """
    sets = units.where(F.col("keys").isNotNull()).groupBy("pid").agg(
        F.first("keys").alias("keys"), F.first("shingles").alias("shingles")
    )
    sets = stage(sets, "unit-sets")
    groups = candidate_groups(sets, settings).join(sets.select(F.col("pid").alias("_pid"), "shingles"), F.col("pid") == F.col("_pid"))
    laid = groups.select("key", "i", "j", "pid", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "pid")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pids, held = None, [], []

        def links() -> Iterator[tuple[bytes, bytes]]:
            if len(held) > 1:
                yield from ((pids[i], pids[j]) for i, j in connected(held, settings.similarity))

        def laid_out(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*found) if found else ([], []))], ["a", "b"])

        for batch in batches:
            found = []
            for *place, pid, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if place != group:
                    found += links()
                    group, pids, held = place, [], []
                pids.append(pid)
                held.append(shingles)
            yield laid_out(found)
        yield laid_out(list(links()))

    return map_batches(laid, compared, "a binary, b binary")


# Groups of so many members are compared set by set, larger ones by arrays.
FEW = 40


def connected(sets: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links (i, j) that connect all members connected by pairs of at least ``least``; sets of eight bytes an element."""
    if len(sets) > FEW:
        return [(i, j) for i, j, _ in similar([np.frombuffer(s, dtype=np.uint64) for s in sets], least)]
    held = [frozenset(memoryview(s).cast("Q")) for s in sets]
    group = list(range(len(held)))
    out = []
    for i, a in enumerate(held):
        for j in range(i + 1, len(held)):
            if group[i] != group[j]:
                common = len(a & held[j])
                if common / (len(a) + len(held[j]) - common) >= least:
                    out.append((i, j))
                    old, new = group[j], group[i]
                    group = [new if x == old else x for x in group]
    return out


def repeated_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, th (hash of the text), spans (word, words, first_doc): the paragraphs to take out of each document."""
    shared = stage(shared_keys(docs, settings), "shared-keys")
    units = stage(repeated_units(docs, shared, settings), "units")
    roots = components(stage(unit_links(units, settings), "unit-links"), "a", "b")
    placed = units.join(roots, F.col("pid") == F.col("node"), "left").select(
        "doc_id", "th", "word", "words", F.coalesce("root", "pid").alias("class")
    )
    at = F.struct("doc_id", "th", "word")
    firsts = placed.groupBy(F.col("class").alias("_class")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    firsts = stage(firsts.where("_first <> _last").select("_class", "_first"), "firsts")
    later = placed.join(firsts, F.col("class") == F.col("_class")).where(at != F.col("_first"))
    span = F.struct("word", "words", F.col("_first.doc_id").alias("first_doc"))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def cut_spans(docs: DataFrame, settings: Settings = Settings(), cut: str = "_cut", spans: str = "_spans") -> DataFrame:
    """The documents without the words of their repeated paragraphs; adds the number of words cut and the spans."""
    doc, th, done = fresh([*docs.columns, cut, spans], "_doc", "_th", "_done")
    found = stage(repeated_spans(docs, settings), "spans")
    found = found.select(F.col("doc_id").alias(doc), F.col("th").alias(th), F.col("spans").alias(spans))

    @F.arrow_udf("struct<text: string, cut: bigint>")
    def without(texts: pa.Array, spans_of: pa.Array) -> pa.Array:
        out = []
        held = spans_of.flatten()
        places = list(zip(held.field("word").to_pylist(), held.field("words").to_pylist()))
        begin = 0
        for text, count in zip(texts, spans_of.value_lengths().to_pylist()):
            if count is not None:
                left, n = cut_words(text.as_py(), places[begin : begin + count], 1)
                out.append({"text": left, "cut": n})
                begin += count
            else:
                out.append(None)
        return pa.array(out, pa.struct([("text", pa.string()), ("cut", pa.int64())]))

    same = (F.col("doc_id") == F.col(doc)) & (F.xxhash64("text") == F.col(th))
    # Texts that lose nothing are not sent to Python.
    touched = F.when(F.col(spans).isNotNull(), F.col("text"))
    both = docs.join(found, same, "left").withColumn(done, without(touched, F.col(spans)))
    both = both.withColumns({cut: F.coalesce(F.col(done)["cut"], F.lit(0).cast("long")), "text": F.coalesce(F.col(done)["text"], "text")})
    return both.select(*docs.columns, cut, spans)


def remove_repeated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without repeated paragraphs; n_chars follows the text, other columns are unchanged."""
    cut, spans = fresh(docs.columns, "_cut", "_spans")
    left = cut_spans(docs, settings, cut, spans)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast("long")
        left = left.withColumn("n_chars", F.when(F.col(cut) == 0, F.col("n_chars")).otherwise(length))
    return left.select(*docs.columns)


@query("op1_paragraphs")
def op1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words removed, the removed paragraphs and in which document the first of each stands, and the text left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = cut_spans(docs)
    none = F.array().cast("array<struct<word:int,words:int,first_doc:bigint>>")
    return left.select("doc_id", F.col("_cut").alias("n_words_cut"), F.coalesce("_spans", none).alias("removed"), "text")
