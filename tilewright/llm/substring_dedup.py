"""Long repeats between documents by recompression.

A round of recompression names runs of one symbol, then pairs of neighbours whose sides, a bit
of each name, are left and right. A name is a fingerprint of what it stands for, so every
task gives equal things the same name without a dictionary. What is named depends on the words next to it only:
a pair, with the words that end its runs, is its context. Wherever a window of
words occurs, the symbols whose context lies inside it are the same.

1. Round by round, tasks parse the documents. Every window chooses the highest of its interior
   symbols, of equally high ones the longest; windows next to each other mostly choose alike,
   so there is about one choice for seven words. A window without such a symbol, as in a
   long run of one word, is named as a whole.
2. Spark counts the chosen names over all documents. Names that two different texts share
   reveal possible repeats; equal windows always share theirs.
3. Windows of shared names are verified: those of one name are grouped by a second, independent
   fingerprint of their words, and each gets the smallest id it occurs under.
4. Words covered by a window that a smaller id has as well are removed.

Texts with the same words are one text, whose smallest id stands for it. Names and digests
are reduced before they are shuffled, and joins split crowded ones; a document only ever meets its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, held, mixed, settled, whole_text
from tilewright.session import SMALL_ROWS, write_table

GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: ASCII white space, which divides words, and a seed for what stands between two texts.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BETWEEN = np.uint64(0xA0761D6478BD642F)

#: Bytes of text that are parsed at a time, at least if there are so many.
PORTION = 1 << 19

#: Bits of a choice: rounds, then bytes, then the name.
ROUND_SHIFT, BYTES_SHIFT = np.uint64(60), np.uint64(54)


@dataclass(frozen=True)
class Settings:
    window: int = 13
    rounds: int = 1
    margin: int = 0  # words beyond the context of a symbol that join its name


def folded(parts: list[np.ndarray]) -> np.ndarray:
    """One fingerprint for what stands in the same place of each part."""
    with np.errstate(over="ignore"):
        out = mixed(parts[0] + GOLDEN)
        for p in parts[1:]:
            out = mixed(out * GOLDEN + p)
    return out


@dataclass
class Symbols:
    """Symbols of one text in order: names, words they span, and words that fix them (their context)."""

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.name)


def beyond(s: Symbols, first: np.ndarray, last: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context of what symbols first..last become, if that also takes the one ``before`` and the one ``after``.

    At the ends of the text there is no such neighbour, but elsewhere there may be one: no window fixes the symbol.
    """
    n, words = len(s), s.stop[-1]
    low, high = np.minimum.reduceat(s.low, first), np.maximum.reduceat(s.high, first)
    for wanted, at, none in ((before, first - 1, first == 0), (after, last + 1, last == n - 1)):
        at = np.clip(at, 0, n - 1)
        low = np.where(wanted, np.where(none, -1, np.minimum(low, s.low[at])), low)
        high = np.where(wanted, np.where(none, words + 1, np.maximum(high, s.high[at])), high)
    return low, high


def run_round(s: Symbols) -> Symbols:
    """One symbol for each run of equal ones. Its neighbours, which end it, fix it too."""
    first = np.flatnonzero(np.r_[True, s.name[1:] != s.name[:-1]])
    last = np.r_[first[1:], len(s)] - 1
    length = (last - first + 1).astype(np.uint64)
    name = np.where(length > 1, folded([s.name[first], length]), s.name[first])
    always = np.ones(len(first), bool)
    return Symbols(name, s.start[first], s.stop[last], *beyond(s, first, last, always, always))


def pair_round(s: Symbols, salt: int) -> tuple[Symbols, np.ndarray]:
    """One symbol for each left one followed by a right one, and which symbols are such pairs."""
    right = (mixed(s.name + np.uint64(salt)) & np.uint64(1)).astype(bool)
    head = np.zeros(len(s), bool)
    head[:-1] = ~right[:-1] & right[1:]
    first = np.flatnonzero(~np.r_[False, head[:-1]])
    is_pair = head[first]
    last = first + is_pair
    name = np.where(is_pair, folded([s.name[first], s.name[last]]), s.name[first])
    # A single symbol is fixed by the neighbour as well that it did not pair with.
    context = beyond(s, first, last, ~is_pair & right[first], ~is_pair & ~right[first])
    return Symbols(name, s.start[first], s.stop[last], *context), is_pair


@dataclass
class Words:
    """Words of several texts: fingerprints, bytes of each, and the first word of every text; the last entry is the end."""

    hashes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Parser:
    """Words, windows and symbols of texts, many texts at a time."""

    def __init__(self, s: Settings):
        self.s = s
        rng = np.random.default_rng(20_240)
        self.letters = [rng.integers(0, 1 << 64, 256, dtype=np.uint64) for _ in range(2)]
        self.places = mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)

    def words(self, texts: list[bytes], table: int = 0) -> Words:
        """Words between ASCII white space. The fingerprints of the two tables are independent."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        blank = BLANK[data]
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        start, size = edges[0::2], edges[1::2] - edges[0::2]
        text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(start, text_start)
        if not len(start):
            return Words(np.zeros(0, np.uint64), size, first)
        before = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(before, size)
        factors = self.places if size.max() <= 4096 else mixed(np.arange(1, size.max() + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            values = self.letters[table][data[~blank]] * factors[place]
            sums = np.add.reduceat(values, before) + size.astype(np.uint64)
        return Words(mixed(sums), size, first)

    def windows(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows that begin ``at`` these words."""
        return folded([hashes[at + k] for k in range(self.s.window)])

    def choices(self, words: Words) -> list[np.ndarray]:
        """Per text, the name every window chooses."""
        w, texts = self.s.window, len(words.first) - 1
        # One sequence; between texts stands a symbol that occurs nowhere else, so nothing across it is inside a window.
        n = len(words.hashes) + texts + 1
        own = np.arange(len(words.hashes)) + words.text + 1
        hashes, size = mixed(np.arange(n, dtype=np.uint64) ^ BETWEEN), np.zeros(n + 1, np.int64)
        hashes[own], size[own + 1] = words.hashes, words.sizes
        size = np.cumsum(size)
        at = np.arange(n)
        now = Symbols(hashes, at, at + 1, at, at + 1)
        best = np.zeros(max(n - w + 1, 0), np.uint64)
        for k in range(1, self.s.rounds + 1):
            now, is_pair = pair_round(run_round(now), k)
            low, high = now.low - self.s.margin, now.high + self.s.margin
            inner = np.flatnonzero(is_pair & (low >= 0) & (high <= n) & (high - low <= w))
            if not len(inner):
                continue
            low, high = low[inner], high[inner]
            # The words at both ends of a symbol belong to every window that chooses it, so they join its name.
            ends = [hashes[e] for d in range(self.s.margin + 1) for e in (low + d, high - 1 - d)]
            name = folded([now.name[inner], *ends, (high - low).astype(np.uint64)])
            long = np.minimum(size[now.stop[inner]] - size[now.start[inner]], 63).astype(np.uint64)
            code = np.uint64(k) << ROUND_SHIFT | long << BYTES_SHIFT | name >> np.uint64(10)
            order = np.argsort(code, kind="stable")  # of symbols that reach one window the greatest comes last
            most = w - int((high - low).min()) + 1  # windows that hold the least context
            code, low, begin = code[order], low[order], high[order] - w
            for d in range(most):
                here = begin + d  # the windows from ``begin`` to ``low`` hold the context
                fits = (here <= low) & (here >= 0) & (here < len(best))
                reached = np.zeros(len(best), np.uint64)
                reached[here[fits]] = code[fits]
                np.maximum(best, reached, out=best)
        starts = words.first[:-1] + np.arange(1, texts + 1)
        counts = np.maximum(np.diff(words.first) - w + 1, 0)
        out = [best[a : a + c] for a, c in zip(starts.tolist(), counts.tolist())]
        every = np.concatenate(out) if out else best
        none = np.flatnonzero(every == 0)
        if len(none):
            place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
            every[none] = self.windows(hashes, place[none]) >> np.uint64(10)
        return np.split(every.view(np.int64), np.cumsum(counts)[:-1])


def parser(s: Settings) -> Parser:
    return held(("recompression", s), lambda: Parser(s))


def portions(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a batch, in portions of about ``PORTION`` bytes."""
    now, size = [], 0
    for value in column:
        now.append(value.as_buffer().to_pybytes())
        size += len(now[-1])
        if size >= PORTION:
            yield now
            now, size = [], 0
    if now:
        yield now


def joined_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a code of the text that finds the row again, and the text."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("code"), text.cast("binary").alias("text"))


def parsed(docs: DataFrame, s: Settings) -> DataFrame:
    """row, doc_id, code, n_words, digest of the words (two longs), sha of all words, distinct choices."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(s)
        for batch in batches:
            done = 0
            for texts in portions(batch.column(2)):
                words = p.words(texts)
                names = [np.unique(x) for x in p.choices(words)]
                joined = [b" ".join(text.split()) for text in texts]
                halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, joined)), "<i8").reshape(-1, 2)
                shas = [hashlib.sha256(x).hexdigest() for x in joined]
                rows = batch.slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(words.first), pa.int64()), pa.array(halves[:, 0]),
                     pa.array(halves[:, 1]), pa.array(shas, pa.string()), pa.array(names, pa.list_(pa.int64())), rows.column(3)],
                    names=["doc_id", "code", "n_words", "high", "low", "sha", "names", "row"],
                )

    columns = "doc_id long, code long, n_words long, high long, low long, sha string, names array<long>, row long"
    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(make, columns)


def candidate_windows(texts: DataFrame, s: Settings) -> DataFrame:
    """One row per text: the windows whose choice is among the shared names, with names, fingerprints and places."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(s)
        for batch in batches:
            done = 0
            for part in portions(batch.column(2)):
                words, again = p.words(part), p.words(part, 1)
                rows = batch.slice(done, len(part))
                done += len(part)
                at, names = [], []
                for shared, own in zip(rows.column(3), p.choices(words)):
                    at.append(np.flatnonzero(np.isin(own, shared.values.to_numpy())))
                    names.append(own[at[-1]])
                place = np.concatenate([x + a for x, a in zip(at, words.first.tolist())])
                found = np.concatenate(names), p.windows(again.hashes, place).view(np.int64), np.concatenate(at)
                offsets = pa.array(np.cumsum([0, *map(len, at)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t)) for v, t in zip(found, (pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *lists], names=["doc_id", "code", "names", "prints", "at"]
                )

    return texts.mapInArrow(make, "doc_id long, code long, names array<long>, prints array<long>, at array<int>")


def without_repeats(texts: DataFrame, s: Settings) -> DataFrame:
    """doc_id, code, n_removed and sha of the kept words, from the places of windows to be removed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, shas = [], []
            for text, places in zip(batch.column(2), batch.column(3)):
                words = text.as_buffer().to_pybytes().split()
                edge = np.zeros(len(words) + 1, np.int64)
                at = places.values.to_numpy()
                np.add.at(edge, at, 1)
                np.add.at(edge, at + s.window, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                n_removed.append(len(words) - len(kept))
                shas.append(joined_sha([words[k] for k in kept]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())],
                names=["doc_id", "code", "removed", "kept_sha"],
            )

    return texts.mapInArrow(make, "doc_id long, code long, removed long, kept_sha string")


def long_repeats(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Words are runs of anything but ASCII white space, unchanged. Removed is each word in a window of
    ``window`` words that a document with a smaller id holds as well. Null, empty and blank texts
    have no words, and texts shorter than a window lose none. Rows repeated under one id do not count
    against each other. A row with a null id is compared with nothing and keeps all its words.
    Other columns are ignored.
    """
    s = settings or Settings()
    columns_of(docs, id_col, text_col)
    made = settled(write_table(parsed(coded(docs, id_col, text_col), s), "parsed"))
    able = made.where((F.col("n_words") >= s.window) & F.col("doc_id").isNotNull())
    texts = able.groupBy("high", "low").agg(F.min(F.struct("doc_id", "row", "code")).alias("lead"))
    texts = write_table(texts.select("high", "low", F.col("lead.doc_id").alias("first_id"), "lead.row", "lead.code"), "texts")
    leads = texts.select("row", F.col("first_id").alias("doc_id"), "code")

    names = able.select("row", F.explode("names").alias("name"))
    shared = names.groupBy("name").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("name")
    shared = settled(write_table(shared, "shared"))
    hits = settled(write_table(names.join(shared, "name").join(leads.select("row", "doc_id"), "row"), "hits"))
    # Names that only copies of one text share, or only rows of one id, are out again.
    least = hits.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("name")
    found = hits.join(least, "name").groupBy("row").agg(F.collect_list("name").alias("names"))  # those of one text
    found = settled(write_table(found.join(leads, "row").select("doc_id", "code", "names"), "found"))

    def with_text(table: DataFrame) -> DataFrame:
        """Rows of ``table`` with their text. A narrow list of them goes first if it is short, so that only
        these texts move; rows repeated under one id collapse before they do."""
        rows = coded(docs, id_col, text_col)
        if table.count() <= SMALL_ROWS:
            rows = rows.join(F.broadcast(table.select("doc_id", "code")), ["doc_id", "code"], "left_semi")
        return rows.dropDuplicates(["doc_id", "code"]).join(table, ["doc_id", "code"])

    near = with_text(found).select("doc_id", "code", "text", "names")
    windows = settled(write_table(candidate_windows(near, s), "windows"))
    each = windows.select("doc_id", "code", F.explode(F.arrays_zip("names", "prints", "at")).alias("w")).select("doc_id", "code", "w.*")
    least = each.groupBy("names", "prints").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    least = settled(write_table(least.where("least < most").select("names", "prints", "least"), "least"))
    repeated = each.join(least, ["names", "prints"]).where("least < doc_id")
    places = settled(write_table(repeated.groupBy("doc_id", "code").agg(F.collect_list("at").alias("places")), "places"))
    cut = with_text(places).select("doc_id", "code", "text", "places")
    cut = settled(write_table(without_repeats(cut, s), "cut"))

    known = texts.join(cut.withColumnRenamed("doc_id", "first_id"), ["first_id", "code"], "left").drop("code", "row")
    rows = made.drop("names", "code", "row").join(known, ["high", "low"], "left")
    copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    named = F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).when(named, F.coalesce("removed", F.lit(0))).otherwise(0).alias("n_removed"),
        F.when(copy, F.lit(joined_sha([]))).when(named, F.coalesce("kept_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"),
    )
