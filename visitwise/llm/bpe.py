"""Byte-level BPE: encoding by ranked merges, decoding by joining the pieces.

A text is cut by the pattern; a match that is itself a token is ready. Others are folded: a
higher-order function walks a string with one character per token and one of the ranks of
neighbours, each step merging the first pair with the lowest rank and looking up the two pairs
that this makes in a literal table. A rank's character is that of the token it makes, so both
strings change by cutting and joining only.

The public pattern never looks across a single space between two other characters, so a text is
first split there, and the distinct parts of many texts are cut together. Other patterns cut whole texts.

Folding happens once per distinct word: for the words that occur often in the corpus, found
by counting them all, once for all documents (at most ``dictionary_words``, shipped to the
tasks), and for the others once in each run of texts (``run_bytes``) that has them. Which words
are in the dictionary, and how long runs are, changes the speed only, never a result. Matches above
``fold_bytes`` bytes, where the fold's cost per step would add up, are merged with a heap instead.
Nothing but word counts is shuffled; texts stay where they are read.

Defined results: null and empty texts have no tokens and decode to nothing; repeated rows are
encoded once each; extra columns are ignored. Special tokens do not exist here.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitwise.llm.common import map_batches, table
from visitwise.llm.registry import query
from visitwise.sources.workspace import stage

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Character of a pair that makes no token; above those of all ranks.
NONE = chr(0x10FFFF)
# Numbers from here on are places in a run's list of words to fold; never token numbers.
LATER = 1 << 31
# A space without white space beside it; what Python calls white space includes what the pattern does.
LONE_SPACE = re.compile(r" (?!\s)(?<!\s )")
WHITE = [chr(i) for i in range(1 << 16) if chr(i).isspace()]
BESIDE_SPACE = [pair for white in WHITE for pair in {white + " ", " " + white}]
# A part of letters below this, alone or before one of the marks, is cut without the pattern's help.
PLAIN_BELOW = chr(0x250)
MARKS = frozenset(".,;:!?")
# A row is a run of some MB, so sizes are looked at after each row; readers hold one row group at a time.
RUN_FILES = {
    "compression": "zstd",
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


@dataclass(frozen=True)
class Settings:
    dictionary_words: int = 400_000
    fold_bytes: int = 256
    counted_words: int = 100_000
    remembered_parts: int = 100_000
    run_bytes: int = 4 << 20
    # A run's texts are split and looked up in blocks, and filled in blocks of tokens.
    block_bytes: int = 512 << 10
    block_tokens: int = 128 << 10


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing[:5]}")
        self.ranks = ranks
        self.pattern = pattern
        self.pieces = {number: piece for piece, number in ranks.items()}

    @classmethod
    def load(cls, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def pairs(self) -> dict[tuple[int, int], int]:
        """(left, right) -> rank of every way to make a token from two tokens."""
        ranks = self.ranks
        return {
            (ranks[piece[:cut]], ranks[piece[cut:]]): rank
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ranks and piece[cut:] in ranks
        }

    @property
    def first(self) -> int:
        """Where the characters of the tokens begin: all are below the surrogates, or all above."""
        return 1 if max(self.pieces) < 0xD7FF else 0xE000

    @cached_property
    def merges(self) -> tuple[int, str, str]:
        """Bits of a rank, offsets and entries of the merge table as JSON, made once for all folds.

        An entry holds its owner + 1 and the rank; 0 where there is none, which is the shortest to write.
        """
        bits = max(self.pieces).bit_length()
        offsets, owners, ranks = merge_table(self.pairs())
        entries = [0] * (max(owners, default=0) + 1)
        for place, left in owners.items():
            entries[place] = (left + 1 << bits) + ranks[place]
        return bits, _json([offsets.get(i) for i in range(max(offsets, default=0) + 1)]), _json(entries)

    def merge_long(self, word: bytes) -> list[int]:
        """Ranked merges with a heap and linked neighbours; for long matches."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        size = len(word)
        stop = list(range(1, size + 1))  # end of the piece that starts here
        before = list(range(-1, size - 1))
        alive = [True] * size
        heap = []

        def offer(left: int) -> None:
            right = stop[left]
            if right < size:
                rank = ranks.get(word[left : stop[right]])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, stop[right]))

        for i in range(size - 1):
            offer(i)
        while heap:
            _, left, end = heapq.heappop(heap)
            right = stop[left] if alive[left] else size
            if right >= size or stop[right] != end:
                continue
            alive[right] = False
            stop[left] = end
            if end < size:
                before[end] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out, at = [], 0
        while at < size:
            out.append(ranks[word[at : stop[at]]])
            at = stop[at]
        return out


class Cutter:
    """Cuts texts into the pattern's matches, by way of parts that repeat."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.by_spaces = pattern == public_tokenizers.PATTERN

    def parts(self, text: str) -> tuple[str, list[str]]:
        """The head, and the later parts without the space that each begins with.

        Head and parts are cut independently: their matches, in order, are those of the text.
        """
        if not self.by_spaces:
            return text, []
        if any(pair in text for pair in BESIDE_SPACE):
            head, *later = LONE_SPACE.split(text)
        else:
            head, *later = text.split(" ")
        return head, later

    def matches(self, part: str) -> list[str]:
        return self.find(" " + part)

    def cut(self, parts: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each part with its matches.

        Parts without white space are cut together: the match that begins with a space begins a part.
        """
        plain = []
        for part in parts:
            word, mark = (part[:-1], part[-1:]) if part[-1:] in MARKS else (part, "")
            if self.by_spaces and word.isalpha() and (word.isascii() or max(word) < PLAIN_BELOW):
                yield part, [" " + word, mark] if mark else [" " + word]
            elif part.split() == [part]:
                plain.append(part)
            else:
                yield part, self.matches(part)
        if plain:
            found = self.find(" " + " ".join(plain))
            starts = [i for i, word in enumerate(found) if word[0] == " "] + [len(found)]
            for part, start, end in zip(plain, starts[:-1], starts[1:], strict=True):
                yield part, found[start:end]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _json(rows: list) -> str:
    return json.dumps(rows, separators=(",", ":"))


def _literal(rows: list, kind: str) -> Column:
    return F.from_json(F.lit(_json(rows)), kind)


def merge_table(pairs: dict[tuple[int, int], int]) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
    """offsets, owners, ranks: rows of one left token, shifted until they do not meet.

    The pair's rank is ranks[offsets[left] + right] if left owns that place, else the pair makes no token.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for (left, right), rank in pairs.items():
        rows.setdefault(left, []).append((right, rank))
    span = 1 << max(8, (4 * len(pairs)).bit_length())
    taken = np.zeros(span + max((right for _, right in pairs), default=0) + 1, dtype=bool)
    offsets: dict[int, int] = {}
    owners: dict[int, int] = {}
    ranks: dict[int, int] = {}
    for left, row in sorted(rows.items(), key=lambda item: (-len(item[1]), item[0])):
        rights = np.array([right for right, _ in row])
        offset = left * 40503 % span
        while taken[offset + rights].any():
            offset = (offset + 7919) % span
        taken[offset + rights] = True
        offsets[left] = offset
        for right, rank in row:
            owners[offset + right] = left
            ranks[offset + right] = rank
    return offsets, owners, ranks


def fold(word: Column, vocabulary: Vocabulary) -> Column:
    """Token numbers of one non-empty word, as array<int>."""
    first = vocabulary.first

    def char(number: int) -> str:
        return chr(first + number)

    def number(of: Column) -> Column:
        return F.ascii(of) - first

    bits, offsets, entries = vocabulary.merges
    tables = F.struct(
        F.from_json(F.lit(offsets), "array<int>").alias("offsets"),
        F.from_json(F.lit(entries), "array<bigint>").alias("entries"),
        _literal([char(i) for i in range(max(vocabulary.pieces) + 1)], "array<string>").alias("chars"),
    )
    # One character per byte, then per token of that byte.
    data = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    single = "".join(char(vocabulary.ranks[bytes([b])]) for b in range(256))
    begun = F.translate(data, "".join(map(chr, range(256))), single)
    one, rest = F.lit(1), F.octet_length(word)

    # Bound once, as each mention of a literal of this size adds to the planning.
    def folded(table: Column) -> Column:
        def rank_of(left: Column, right: Column) -> Column:
            """The rank's character; NONE where ``right`` is empty or null, beyond the word's end."""
            place = F.get(table["offsets"], number(left)) + number(right)
            entry = F.get(table["entries"], place)
            rank = entry.bitwiseAND((1 << bits) - 1).cast("int")
            return F.when(F.shiftright(entry, bits) == number(left) + 1, F.get(table["chars"], rank)).otherwise(NONE)

        # ranks[i] is that of ids[i] and ids[i + 1]; the last one is NONE.
        def begin(ids: Column) -> Column:
            def ranked(chars: Column) -> Column:
                return F.array_join(F.zip_with(chars, F.slice(chars, F.lit(2), F.size(chars)), rank_of), "")

            return F.struct(ids.alias("ids"), _let(F.split(ids, ""), ranked).alias("ranks"))

        def step(state: Column, _: Column) -> Column:
            ids, ranks = state["ids"], state["ranks"]

            def at(lowest: Column) -> Column:
                def joined(place: Column) -> Column:
                    before = F.concat(
                        ranks.substr(one, place - 2), rank_of(ids.substr(place - 1, one), lowest)
                    )
                    return F.struct(
                        F.concat(ids.substr(one, place - 1), lowest, ids.substr(place + 2, rest)).alias("ids"),
                        F.concat(
                            F.when(place > 1, before).otherwise(F.lit("")),
                            rank_of(lowest, ids.substr(place + 2, one)),
                            ranks.substr(place + 2, rest),
                        ).alias("ranks"),
                    )

                return F.when(lowest == NONE, state).otherwise(_let(F.instr(ranks, lowest), joined))

            return _let(F.array_min(F.split(ranks, "")), at)

        # A word of n bytes has at most n - 1 merges.
        turns = F.when(F.octet_length(word) > 1, F.sequence(F.lit(2), F.octet_length(word))).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(turns, _let(begun, begin), step, lambda state: F.transform(F.split(state["ids"], ""), number))

    return _let(tables, folded)


def word_counts(docs: DataFrame, vocabulary: Vocabulary, settings: Settings = Settings()) -> DataFrame:
    """word, n: how often each word that has to be folded occurs in all documents."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((vocabulary.pattern, frozenset(vocabulary.ranks)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, ready = known.value
        cutter = Cutter(pattern)
        heads: Counter[str] = Counter()
        counts: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            found = heads.copy()
            for part, words in cutter.cut(counts):
                for word in words:
                    found[word] += counts[part]
            kept = []
            for word, n in found.items():
                raw = word.encode("utf-8", "surrogatepass")
                if len(raw) <= settings.fold_bytes and raw not in ready:
                    kept.append((word, n))
            words, ns = zip(*kept) if kept else ((), ())
            counts.clear()
            heads.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                head, parts = cutter.parts(text.as_py() or "")
                heads.update(cutter.find(head))
                counts.update(parts)
                if len(heads) + len(counts) > settings.counted_words:
                    yield flushed()
        yield flushed()

    found = map_batches(docs.select("text"), count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Folded:
    """Words and their token numbers; Arrow buffers on the driver and on the way, a dict where they are looked up."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words = words
        self.ids = ids

    @cached_property
    def numbers(self) -> dict[str, bytes]:
        """Numbers in four bytes each, lowest first."""
        data = self.ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = 4 * np.cumsum(self.ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        found, start = {}, 0
        for word, end in zip(self.words, ends):
            found[word.as_py()] = data[start:end]
            start = end
        return found


def dictionary(docs: DataFrame, vocabulary: Vocabulary, settings: Settings = Settings()) -> Folded:
    """Folded words by descending count, as many as ``dictionary_words`` allows."""
    counts = stage(word_counts(docs, vocabulary, settings), "bpe-words")
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, least = 0, math.inf
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["words"]
        if total > settings.dictionary_words:
            break
        least = row["level"]
    if least is math.inf:
        return Folded(pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())))
    chosen = counts.where(level >= int(least)).repartition("word")
    folded = chosen.select("word", fold(F.col("word"), vocabulary).alias("ids")).toArrow()
    return Folded(folded.column("word").combine_chunks(), folded.column("ids").combine_chunks())


@dataclass(frozen=True)
class Encoded:
    """What ``encode`` returns beside doc_id: the token numbers, the decoded bytes, or digests of both."""

    ids: bool = True
    data: bool = False
    digests: bool = False

    @property
    def fields(self) -> list[tuple[str, str, pa.DataType]]:
        found = [("n_tokens", "bigint", pa.int64())]
        if self.ids:
            found.append(("ids", "array<int>", pa.list_(pa.int32())))
        if self.data:
            found.append(("data", "binary", pa.binary()))
        if self.digests:
            found += [("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
        return found

    def row(self, ids: np.ndarray, piece) -> tuple:
        found: list = [len(ids)]
        data = b"".join(map(piece, ids.tolist())) if self.data or self.digests else b""
        if self.ids:
            found.append(ids.astype(np.int32))
        if self.data:
            found.append(data)
        if self.digests:
            found += [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()]
        return tuple(found)


def halves(ids: np.ndarray) -> bytes:
    """The low halves of all numbers, then the high ones, which are nearly all zero and so take no room on disk."""
    return ids.astype("<u2").tobytes() + (ids >> np.uint32(16)).astype("<u2").tobytes()


def whole(data: pa.Buffer) -> np.ndarray:
    """The numbers that ``halves`` wrote."""
    low, high = np.frombuffer(data, dtype="<u2").reshape(2, -1).astype(np.uint32)
    return low | high << np.uint32(16)


def filled(
    ids: np.ndarray, widths: np.ndarray, starts: np.ndarray, flat: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the numbers of the folded words in their places, and where each of ``ids`` begins among them."""
    gaps = ids >= LATER
    which = (ids[gaps] - np.uint32(LATER)).astype(np.int64)
    lengths = np.ones(len(ids), dtype=np.int64)
    lengths[gaps] = widths[which]
    # The numbers of the words in the places' order, one word after the other.
    ends = np.cumsum(widths[which])
    taken = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + widths[which], widths[which])
    spread = np.repeat(ids, lengths)
    spread[np.repeat(gaps, lengths)] = flat[taken].astype(np.uint32)
    return spread, np.concatenate([[0], np.cumsum(lengths)])


def encode(
    docs: DataFrame, vocabulary: Vocabulary, settings: Settings = Settings(), returns: Encoded = Encoded()
) -> DataFrame:
    """doc_id, n_tokens and what ``returns`` names for each whole text.

    Runs of texts are looked up and folded first, and written to the shared folder as numbers; decoding joins the
    pieces of the numbers just found, in the task that fills the folded words in.
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast((vocabulary.ranks, vocabulary.pattern, dictionary(docs, vocabulary, settings)))
    pieces = spark.sparkContext.broadcast(vocabulary.pieces)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int | None], list[str]]]:
        """Characters, identifiers and texts of as many documents as ``block_bytes`` allows, at least one."""
        ids: list[int | None] = []
        texts: list[str] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                text = text.as_py() or ""
                if ids and held + len(text) > settings.block_bytes:
                    yield held, ids, texts
                    ids, texts, held = [], [], 0
                ids.append(doc_id.as_py())
                texts.append(text)
                held += len(text)
        if ids:
            yield held, ids, texts

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's doc_ids, how many numbers each has, the numbers, and the words whose places stand among them."""
        ranks, pattern, folded = common.value
        ready = folded.numbers
        vocabulary = Vocabulary(ranks, pattern)
        cutter = Cutter(pattern)
        memo: dict[str, bytes] = {}
        # Of the run: words to fold, the codes of its parts, identifiers and codes of its texts.
        rare: dict[str, int] = {}
        codes: dict[str, bytes] = {}
        doc_ids: list[int | None] = []
        coded: list[bytes] = []
        held = 0

        def numbers(word: str) -> bytes:
            part = ready.get(word)
            if part is None:
                raw = word.encode("utf-8", "surrogatepass")
                if raw in ranks:
                    part = ranks[raw].to_bytes(4, "little")
                elif len(raw) > settings.fold_bytes:
                    part = np.array(vocabulary.merge_long(raw), dtype="<u4").tobytes()
                else:
                    part = (LATER + rare.setdefault(word, len(rare))).to_bytes(4, "little")
            return part

        def learn(parts: set[str]) -> None:
            unknown = []
            for part in parts:
                known = memo.get(part)
                if known is None:
                    unknown.append(part)
                else:
                    codes[part] = known
            for part, words in cutter.cut(unknown):
                codes[part] = b"".join(map(numbers, words))
                if len(part) <= 64 and not any(word in rare for word in words):
                    if len(memo) >= settings.remembered_parts:
                        memo.clear()
                    memo[part] = codes[part]

        def flushed() -> pa.RecordBatch:
            run = pa.RecordBatch.from_arrays(
                [
                    pa.array([doc_ids], pa.list_(pa.int64())),
                    pa.array([[len(text) // 4 for text in coded]], pa.list_(pa.int64())),
                    pa.array([halves(np.frombuffer(b"".join(coded), dtype="<u4"))], pa.binary()),
                    pa.array([list(rare)], pa.list_(pa.string())),
                ],
                ["doc_ids", "sizes", "numbers", "rare"],
            )
            for held_by_run in (rare, codes, doc_ids, coded):
                held_by_run.clear()
            return run

        for size, ids, texts in blocks(batches):
            if doc_ids and held + size > settings.run_bytes:
                yield flushed()
                held = 0
            split = [cutter.parts(text) for text in texts]
            learn({part for _, later in split for part in later if part not in codes})
            for head, later in split:
                coded.append(b"".join([*map(numbers, cutter.find(head)), *map(codes.__getitem__, later)]))
            doc_ids += ids
            held += size
        if doc_ids:
            yield flushed()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.value.__getitem__
        names, _, kinds = zip(*returns.fields)
        for batch in batches:
            for doc_ids, sizes, numbers, rare in zip(*batch.columns):
                ids = whole(numbers.as_buffer())
                widths = rare.values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.cumsum(widths) - widths
                flat = rare.values.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes.values.to_numpy(zero_copy_only=False))
                first, begin = 0, 0
                while first < len(ends):
                    # As many documents as ``block_tokens`` allows, at least one.
                    last = max(first + 1, int(np.searchsorted(ends, begin + settings.block_tokens, side="right")))
                    spread, tokens = filled(ids[begin : ends[last - 1]], widths, starts, flat)
                    cuts = tokens[np.concatenate([[0], ends[first:last] - begin])]
                    rows = [returns.row(spread[a:b], piece) for a, b in zip(cuts[:-1], cuts[1:])]
                    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.values.slice(first, last - first), *columns], ["doc_id", *names]
                    )
                    first, begin = last, int(ends[last - 1])

    looked = map_batches(
        docs.select("doc_id", "text"),
        look_up, "doc_ids array<bigint>, sizes array<bigint>, numbers binary, rare array<string>"
    )
    folded = F.transform("rare", lambda word: fold(word, vocabulary))
    # Written here, so that no task holds two Python workers; they are kept and would add up over a pipeline.
    ready = stage(looked.select("doc_ids", "sizes", "numbers", folded.alias("rare")), "bpe-runs", options=RUN_FILES)
    return map_batches(ready, fill, "doc_id bigint, " + ", ".join(f"{name} {kind}" for name, kind, _ in returns.fields))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, data: the joined pieces of a table of token numbers."""
    pieces = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces.value.__getitem__
        for batch in batches:
            data = [b"".join(map(piece, ids.values.to_pylist())) if ids.is_valid else None for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "data"]
            )

    return map_batches(encoded.select("doc_id", "ids"), join, "doc_id bigint, ids array<int>, data binary")


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Vocabulary.load(), returns=Encoded(ids=False, digests=True))
