"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, removal by components.

Paragraphs are the lines of a text with at least ``min_words`` words and, where ``blocks`` is set,
the runs of shorter lines between those and blank lines, if a run has as many words. Words are
compared with A-Z lower-cased.

1. Every paragraph has a 128-bit digest of its words, so equal paragraphs are one node.
2. ``bands`` band keys of ``rows`` MinHash values each are shuffled; keys that hold two or
   more different paragraphs are the candidate buckets. With 10 bands of 3 rows a pair at
   similarity 0.8 is missed with a chance of 0.0008. Buckets with the same members are one.
3. The members' shingle sets meet by bucket and the exact Jaccard similarity is taken. Pairs
   that are connected already are skipped, so a bucket of m copies costs about m comparisons
   and gives m - 1 links, never all pairs. Buckets above ``block`` members are cut into blocks
   and every pair of blocks is one task, so no group is gathered whole and none is capped.
4. Components of the links are the classes; the first paragraph by (doc_id, line) stays and
   the others are removed from their texts.

``cut_repeated_passages`` then finds what paragraphs cannot: passages inside longer lines, and
passages over lines that are broken elsewhere. All words of a text, whatever its line breaks, lie
in pieces of some ten words that end where a hash of the last two words says so, so a repeated
passage has the same pieces wherever it stands, but for its two ends. Equal pieces are found by
their digests, and runs of at least ``min_words`` repeated words are cut. Of equal pieces the first
by (doc_id, place) always stays. ``remove_repeated_passages`` is both steps.

Defined results: null and empty texts, and rows without an id, stay as they are; repeated rows
(equal id and text) are one document and get equal results; extra columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitwise.llm.components import components
from visitwise.llm.repetition import mix
from visitwise.sources.workspace import stage

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Settings:
    min_words: int = 15
    # Shorter lines are joined to paragraphs; without it only lines of min_words are compared.
    blocks: bool = False
    piece_least: int = 6
    piece_cut: int = 6
    piece_most: int = 40
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 10
    rows: int = 3
    block: int = 2000
    seed: int = 3
    memo_words: int = 300_000
    seen_paragraphs: int = 500_000
    # A filter of 2 ** filter_bits bits (16 MB) is sent to the tasks.
    filter_bits: int = 27


#: Lines and the runs of shorter ones.
WHOLE = Settings(blocks=True)


class Shingler:
    """Digests, shingle hashes and band keys of paragraphs."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.memo: dict[bytes, int] = {}
        rng = np.random.default_rng(settings.seed)
        count = settings.bands * settings.rows
        self.factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def paragraphs(self, text: str | None) -> list[tuple[int, int, list[bytes]]]:
        """(first line, number of lines, words) of the paragraphs that are long enough."""
        found = []
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        least, begin, block = self.settings.min_words, 0, []
        for line, content in enumerate([*raw.split(b"\n"), b""]):
            words = content.split()
            if words and len(words) < least and self.settings.blocks:
                begin = begin if block else line
                block += words
                continue
            if len(block) >= least:
                found.append((begin, line - begin, block))
            block = []
            if len(words) >= least:
                found.append((line, 1, words))
        return found

    def codes(self, words: list[bytes]) -> np.ndarray:
        """64-bit hashes of words."""
        memo = self.memo
        if len(memo) > self.settings.memo_words:
            memo.clear()
        values = []
        for word in words:
            value = memo.get(word)
            if value is None:
                value = memo[word] = xxhash.xxh64_intdigest(word)
            values.append(value)
        return np.array(values, dtype=np.uint64)

    def pieces(self, text: str | None) -> Iterator[tuple[int, int, bytes]]:
        """(first word, number of words, digest) of the pieces of a text; every word is in one."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return
        values = self.codes(words)
        pairs = mix(values[1:] ^ mix(values[:-1]))
        ends = np.flatnonzero(pairs % np.uint64(self.settings.piece_cut) == 0) + 2
        begin = 0
        for end in [*ends.tolist(), len(words)]:
            while end - begin > self.settings.piece_most:
                yield begin, self.settings.piece_most, digest(words[begin : begin + self.settings.piece_most])
                begin += self.settings.piece_most
            if end - begin >= self.settings.piece_least or end == len(words) > begin:
                yield begin, end - begin, digest(words[begin:end])
                begin = end

    def shingles(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the word shingles, sorted."""
        values = self.codes(words)
        n = min(self.settings.shingle, len(words))
        code = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for j in range(n):
            code = mix(code ^ values[j : j + len(code)])
        return np.unique(code)

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """paragraphs x bands"""
        lengths = np.array([len(s) for s in sets])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        every = np.concatenate(sets)
        lows = np.empty((len(sets), len(self.factors)), dtype=np.uint64)
        for k, (factor, shift) in enumerate(zip(self.factors, self.shifts)):
            # The hashes are mixed already, so an odd multiple and a shift give another order of them.
            lows[:, k] = np.minimum.reduceat(every * factor + shift, starts)
        bands = lows.reshape(len(sets), self.settings.bands, self.settings.rows)
        key = mix(np.arange(self.settings.bands, dtype=np.uint64))[None, :] * np.ones((len(sets), 1), np.uint64)
        for j in range(self.settings.rows):
            key = mix(key ^ bands[:, :, j])
        return key.view(np.int64)


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def short(pid: bytes) -> int:
    """The leading 64 bits of a digest, as a signed number."""
    return int.from_bytes(pid[:8], "big", signed=True)


def _keyed(docs: DataFrame) -> DataFrame:
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select("doc_id", F.xxhash64("text").alias("th"), "text")


def paragraph_table(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, th (hash of the text), line, lines, pid (digest): one row per paragraph."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for batch in batches:
            rows = [
                (doc_id.as_py(), th.as_py(), line, lines, digest(words))
                for doc_id, th, text in zip(*batch.columns)
                for line, lines, words in shingler.paragraphs(text.as_py())
            ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "line", "lines", "pid"])

    return _keyed(docs).mapInArrow(apply, "doc_id bigint, th bigint, line int, lines int, pid binary")


def band_keys(docs: DataFrame, settings: Settings) -> DataFrame:
    """key, h (leading bits of the digest): the bands of each paragraph, mostly once per paragraph and task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        seen: set[int] = set()
        for batch in batches:
            ids, sets = [], []
            for text in batch.column(0):
                for _, _, words in shingler.paragraphs(text.as_py()):
                    h = short(digest(words))
                    if h not in seen:
                        seen.add(h)
                        ids.append(h)
                        sets.append(shingler.shingles(words))
            if len(seen) > settings.seen_paragraphs:
                seen.clear()
            if ids:
                keys = shingler.keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(np.array(ids), settings.bands))], ["key", "h"]
                )

    return _keyed(docs).select("text").mapInArrow(apply, "key bigint, h bigint")


def buckets(keys: DataFrame) -> DataFrame:
    """key, h, n: buckets of two or more different paragraphs, one for each different set of members."""
    by_key = Window.partitionBy("key")
    low, high = F.min("h").over(by_key), F.max("h").over(by_key)
    shared = keys.withColumns({"_low": low, "_high": high}).where("_low <> _high").select("key", "h").distinct()
    shared = stage(shared, "bands")
    members = shared.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("h")).alias("x"),
        F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"),
    )
    chosen = members.groupBy("n", "x", "y").agg(F.min("key").alias("_key"))
    return shared.join(chosen.select("_key", "n"), F.col("key") == F.col("_key")).select("key", "h", "n")


def bit_filter(wanted: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value's low ``bits`` bits. Its size is fixed: 2 ** bits / 8 bytes, whatever it is made from."""
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    marks = wanted.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in marks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect():
        part = np.frombuffer(row["map"], dtype=np.uint8)
        begin = (row["bucket"] - 1) * len(part)
        out[begin : begin + len(part)] = part[: len(out) - begin]
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """h, pid, shingles of the paragraphs whose h is in ``wanted``.

    The texts are read again where they lie: a bit filter of fixed size leaves out nearly all other
    paragraphs, and the join takes out those that share a bit by chance.
    """
    known = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "h", settings.filter_bits))
    low = (1 << settings.filter_bits) - 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        bits = known.value
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                for _, _, words in shingler.paragraphs(text.as_py()):
                    pid = digest(words)
                    h = short(pid)
                    slot = h & low
                    if bits[slot >> 3] >> (slot & 7) & 1 and pid not in seen:
                        seen.add(pid)
                        rows.append((h, pid, shingler.shingles(words).tobytes()))
            if len(seen) > settings.seen_paragraphs:
                seen.clear()
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "pid", "shingles"])

    found = _keyed(docs).select("text").mapInArrow(apply, "h bigint, pid binary, shingles binary")
    return found.join(wanted, "h", "left_semi").dropDuplicates(["pid"])


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int, float]]:
    """Links (i, j, Jaccard) that connect all members connected by pairs of at least ``least``."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(count), sizes)[order]
    # Of each element: where its owners begin and end.
    first = np.flatnonzero(np.append(True, np.diff(values[order]) != 0)) if len(values) else order
    bounds = np.append(first, len(values))
    number = np.empty(len(values), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(bounds))
    starts = np.cumsum(sizes) - sizes
    group = np.arange(count)
    links = []
    for i in range(count - 1):
        others = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not len(others):
            continue
        own = number[starts[i] : starts[i] + sizes[i]].tolist()
        common = np.bincount(np.concatenate([owner[bounds[e] : bounds[e + 1]] for e in own]), minlength=count)[others]
        score = common / (sizes[i] + sizes[others] - common)
        for j, s in zip(others[score >= least].tolist(), score[score >= least].tolist()):
            if group[j] != group[i]:
                links.append((i, j, s))
                group[group == group[j]] = group[i]
    return links


def links(docs: DataFrame, settings: Settings) -> DataFrame:
    """a, b (digests), similarity: links enough to connect every class of near-equal paragraphs."""
    members = stage(buckets(band_keys(docs, settings)), "buckets")
    needed = stage(members.select("h").distinct(), "bucket-members")
    sets = shingle_sets(docs, needed, settings)
    parts = F.ceil(F.col("n") / settings.block).cast("int")
    own = F.pmod(F.xxhash64("h"), parts).cast("int")
    dealt = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("key", "h", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("pid")
        pids = group.column("pid").to_pylist()
        found = similar([np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()], settings.similarity)
        return pa.table(
            {
                "a": pa.array([pids[i] for i, _, _ in found], pa.binary()),
                "b": pa.array([pids[j] for _, j, _ in found], pa.binary()),
                "similarity": pa.array([s for _, _, s in found], pa.float64()),
            }
        )

    return (
        dealt.join(sets, "h")
        .select("key", "i", "j", "pid", "shingles")
        .groupBy("key", "i", "j")
        .applyInArrow(compare, "a binary, b binary, similarity double")
    )


def repeated_paragraphs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, th, removed (line, first_doc): the lines to take out of each document that has any."""
    rows = stage(paragraph_table(docs, settings), "paragraphs")
    near = stage(links(docs, settings), "paragraph-links")
    roots = components(near, "a", "b")
    placed = rows.join(roots, F.col("pid") == F.col("node"), "left").select(
        "doc_id", "th", "line", "lines", F.coalesce("root", "pid").alias("class")
    )
    placed = stage(placed, "paragraph-classes")
    at = F.struct("doc_id", "th", "line")
    firsts = placed.groupBy(F.col("class").alias("_class")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    firsts = firsts.where("_first <> _last").select("_class", "_first")
    later = placed.join(firsts, F.col("class") == F.col("_class")).where(at != F.col("_first")).distinct()
    later = later.withColumn("line", F.explode(F.sequence("line", F.col("line") + F.col("lines") - 1)))
    return later.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.struct("line", F.col("_first.doc_id").alias("first_doc")))).alias("removed")
    )


def _joined(docs: DataFrame, settings: Settings) -> DataFrame:
    """The documents with ``_removed`` and the text without the removed lines."""
    found = stage(repeated_paragraphs(docs, settings), "removed").select(
        F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("removed").alias("_removed")
    )
    same = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_th"))
    lines = F.transform("_removed", lambda r: r["line"])
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(lines, i))
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return docs.join(found, same, "left").withColumn("_kept_text", text)


def remove_repeated_paragraphs(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without repeated paragraphs; n_chars follows the text, other columns are unchanged."""
    changed = {"text": F.col("_kept_text")}
    if "n_chars" in docs.columns:
        length = F.char_length("_kept_text").cast("long")
        changed["n_chars"] = F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(length)
    return _joined(docs, settings).withColumns(changed).select(*docs.columns)


def piece_rows(docs: DataFrame, settings: Settings, known: np.ndarray | None = None) -> DataFrame:
    """doc_id, th, word, words, pid: one row per piece; with ``known`` only those whose digest meets that bit filter."""
    bits = None if known is None else docs.sparkSession.sparkContext.broadcast(known)
    low = (1 << settings.filter_bits) - 1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            rows = []
            for doc_id, th, text in zip(*batch.columns):
                doc_id, th = doc_id.as_py(), th.as_py()
                for word, words, pid in shingler.pieces(text.as_py()):
                    slot = short(pid) & low
                    if bits is None or bits.value[slot >> 3] >> (slot & 7) & 1:
                        rows.append((doc_id, th, word, words, pid))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "word", "words", "pid"])

    return _keyed(docs).mapInArrow(apply, "doc_id bigint, th bigint, word int, words int, pid binary")


def repeated_pieces(docs: DataFrame, settings: Settings = WHOLE) -> DataFrame:
    """doc_id, th, pieces (word, words, first_doc): the pieces of each document that stand earlier too.

    The texts are read again for the places of the repeated ones, so all pieces are shuffled once only.
    """
    at = F.struct("doc_id", "th", "word")
    firsts = piece_rows(docs, settings).groupBy(F.col("pid").alias("_pid")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    firsts = stage(firsts.where("_first <> _last").select("_pid", "_first"), "piece-firsts")
    heads = firsts.select(F.conv(F.hex(F.substring("_pid", 1, 8)), 16, -10).cast("long").alias("h"))
    again = piece_rows(docs, settings, bit_filter(heads, "h", settings.filter_bits))
    later = again.join(firsts, F.col("pid") == F.col("_pid")).where(at != F.col("_first"))
    piece = F.struct("word", "words", F.col("_first.doc_id").alias("first_doc"))
    return later.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(piece)).alias("pieces"))


def cut_words(text: str, spans: list[tuple[int, int]], least: int) -> tuple[str, int]:
    """The text without the words in ``spans`` (first word, words; in order), and their number.

    Adjoining spans count as one; those of less than ``least`` words stay. Lines that lose all their words go.
    """
    runs: list[list[int]] = []
    for word, words in spans:
        if runs and runs[-1][1] == word:
            runs[-1][1] += words
        else:
            runs.append([word, word + words])
    gone = bytearray(max((b for _, b in runs), default=0))
    for a, b in runs:
        if b - a >= least:
            gone[a:b] = b"\x01" * (b - a)
    count = gone.count(1)
    if not count:
        return text, 0
    lines, at = [], 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = len(line.split())
        dead = gone[at : at + words]
        at += words
        n = dead.count(1)
        if not n:
            lines.append(line)
        elif n < words:
            places = [m.span() for m in WORD.finditer(line)]
            dead += bytes(words - len(dead))
            kept, begin = b"", 0
            for i, (_, end) in enumerate(places):
                if not dead[i]:
                    kept += line[begin:end]
                # A word goes with the white space before it, or after it at the start of a line.
                begin = end if kept or i + 1 == len(places) else places[i + 1][0]
            lines.append(kept + line[places[-1][1] :])
    return b"\n".join(lines).decode("utf-8", "surrogatepass"), count


def cut_repeated_passages(docs: DataFrame, settings: Settings = WHOLE) -> DataFrame:
    """The documents with ``_cut`` (words cut) and the text without the words of repeated pieces."""
    found = stage(repeated_pieces(docs, settings), "repeated-pieces").select(
        F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("pieces").alias("_pieces")
    )
    least = settings.min_words

    @F.arrow_udf("struct<text: string, cut: bigint>")
    def cut(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts, pieces):
            if spans.is_valid:
                left, n = cut_words(text.as_py(), [(p["word"], p["words"]) for p in spans.as_py()], least)
                out.append({"text": left, "cut": n})
            else:
                out.append(None)
        return pa.array(out, pa.struct([("text", pa.string()), ("cut", pa.int64())]))

    same = (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_th"))
    # Texts that lose nothing are not sent to Python.
    touched = F.when(F.col("_pieces").isNotNull(), F.col("text"))
    both = docs.join(found, same, "left").withColumn("_done", cut(touched, F.col("_pieces")))
    both = both.withColumn("_cut", F.coalesce("_done.cut", F.lit(0).cast("long")))
    return both.withColumn("text", F.coalesce("_done.text", "text")).drop("_done", "_doc", "_th", "_pieces")


def remove_repeated_passages(docs: DataFrame, settings: Settings = WHOLE) -> DataFrame:
    """The documents without repeated paragraphs and passages; n_chars follows the text, other columns are unchanged."""
    left = stage(remove_repeated_paragraphs(docs, settings), "paragraphs-removed")
    cut = cut_repeated_passages(left, settings)
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast("long")
        cut = cut.withColumn("n_chars", F.when(F.col("_cut") == 0, F.col("n_chars")).otherwise(length))
    return cut.select(*docs.columns)
