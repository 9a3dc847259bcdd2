"""Alignment of two tokenizers over the same bytes.

Each tokenizer cuts a text where its tokens end. A cut that both make is shared, and
shared cuts divide a text into groups. They are found by divide and conquer: from the middle of
the first tokenizer's open ends outwards, ends are sought among the second's by bisection;
the shared one next to the middle divides the interval, both halves are treated alike, and an
interval without one is a group. Short intervals are settled by one bisection of all their ends.

How many documents hold a pair of linked ids is counted over the corpus. The most frequent
pairs, a number bounded by ``hot_pairs``, go to all tasks; what else a document holds meets
its counts in a join. Texts are encoded once: their distinct pairs are written.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import columns_of, held, whole_text
from tilewright.llm.prefix_table import byte_letters
from tilewright.llm.tokens import tokenizer_path
from tilewright.session import write_table

#: Tokenizers of the query: the first is given a blank before the text, the second adds it itself.
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"

#: Fixed value of byte-level tokenizers: how they split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts with longer words or longer runs of white space go to the ``tokenizers`` library.
LONG = 1000
BLANKS = re.compile(rf"\s{{{LONG}}}")

#: Pairs of ids that go to all tasks with their counts, at most.
HOT_PAIRS = 200_000

#: Intervals of so many ends are settled at once.
SHORT = 256


def shared_cuts(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ends that both hold, rising. Both arrays rise and close with the same end."""
    if not len(first):
        return first
    found = [first[-1:]]
    open_ = [(0, len(first) - 1, 0, len(second) - 1)]

    def sought(low: int, high: int, other_low: int, other_high: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ends low..high - 1 are among the other's, and their places there."""
        ends = first[low:high]
        at = other_low + np.searchsorted(second[other_low:other_high], ends)
        hits = (second[np.minimum(at, other_high - 1)] == ends).nonzero()[0]
        return low + hits, at[hits]

    while open_:
        low, high, other_low, other_high = open_.pop()
        if low >= high or other_low >= other_high:
            continue
        if high - low <= SHORT:
            found.append(first[sought(low, high, other_low, other_high)[0]])
            continue
        middle, reach = (low + high) // 2, SHORT // 2
        while True:
            here, there = sought(max(low, middle - reach), min(high, middle + reach), other_low, other_high)
            if len(here):
                k = np.abs(here - middle).argmin()
                cut, other = int(here[k]), int(there[k])
                found.append(first[cut : cut + 1])
                open_ += (low, cut, other_low, other), (cut + 1, high, other + 1, other_high)
                break
            if middle - reach <= low and middle + reach >= high:
                break
            reach *= 2
    return np.sort(np.concatenate(found))


def linked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of each pair whose byte ranges overlap: one pair up to every end of either."""
    one, two = (np.zeros(int(first[-1]) + 1 if len(first) else 0, np.int64) for _ in range(2))
    one[first], two[second] = 1, 1
    ends = np.flatnonzero(one | two)
    one, two = one[ends], two[ends]
    return np.cumsum(one) - one, np.cumsum(two) - two


def spelling(ids: range, close: str) -> np.ndarray:
    """Each id in decimal with ``close`` behind it."""
    out = np.empty(len(ids), object)
    out[:] = [f"{i}{close}" for i in ids]
    return out


class Aligner:
    """Tokens of texts by two tokenizers, their groups, and the pairs of linked ids."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = tokenizer_path(first)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        letters, vocabulary = byte_letters(), parts["model"]["vocab"]
        a_bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items() if all(c in letters for c in t)}
        self.quick = self._quick(parts, a_bytes)
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(second))
        self.b_bytes = [self._second_bytes(i) for i in range(self.b.get_piece_size())]
        size = max(self.a.get_vocab_size(), max(vocabulary.values()) + 1)
        self.a_length = np.array([len(a_bytes.get(i, b"")) for i in range(size)], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        sides = range(size), range(len(self.b_bytes))
        self.inner = [spelling(ids, ",") for ids in sides]
        self.closing = [spelling(ids, close) for ids, close in zip(sides, "|;")]

    @staticmethod
    def _quick(parts: dict, spelled: dict[int, bytes]):
        """The same vocabulary in ``tiktoken``, if ids go by the rank of their merges and texts are split the common way."""
        vocabulary, merges = parts["model"]["vocab"], parts["model"]["merges"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        split = parts["pre_tokenizer"]
        if made != list(range(256, 256 + len(made))) or parts["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            return None
        import tiktoken

        return tiktoken.Encoding("first", pat_str=WORDS, mergeable_ranks={raw: i for i, raw in spelled.items()}, special_tokens={})

    def _second_bytes(self, token: int) -> bytes:
        piece = self.b.id_to_piece(token)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(token) else piece.replace("▁", " ").encode()

    def first_ids(self, text: str) -> np.ndarray:
        if self.quick and max(map(len, text.split()), default=0) < LONG and not BLANKS.search(text):
            return np.array(self.quick.encode_ordinary(text), np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and token ends of both sides; None if a side does not spell the blank and the text."""
        want = f" {text}".encode()
        a = self.first_ids(f" {text}")  # byte-level: spells every text
        b = self.b.encode(text, num_threads=1)
        if b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        b = np.array(b, np.int64)
        return a, b, np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])

    def groups_text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        sides = []
        for k, (ids, last) in enumerate(((a, last_a), (b, last_b))):
            words = self.inner[k][ids]
            words[last] = self.closing[k][ids[last]]
            sides.append(words)
        count_a, count_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        out[np.arange(len(a)) + np.repeat(last_b + 1 - count_b, count_a)] = sides[0]
        out[np.arange(len(b)) + np.repeat(last_a + 1, count_b)] = sides[1]
        return "".join(out.tolist())[:-1]

    def of(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """Tokens of both sides, groups, their text, and the pairs of linked ids; nothing for a text without tokens."""
        sides = self.encoded(text) if text else None
        if sides is None:
            return 0, 0, 0, "", np.zeros(0, np.int64)
        a, b, ends_a, ends_b = sides
        cuts = shared_cuts(ends_a, ends_b)
        i, j = linked(ends_a, ends_b)
        return len(a), len(b), len(cuts), self.groups_text(*sides, cuts), a[i] << 32 | b[j]


def aligner(first: str, second: str) -> Aligner:
    return held(("align", first, second), lambda: Aligner(first, second))


def measured(docs: DataFrame, first: str, second: str, id_col: str, text_col: str) -> DataFrame:
    """Row number, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and how often each is linked."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = aligner(first, second)
        for batch in batches:
            out = [[] for _ in range(7)]
            for value in batch.column(2):
                n_a, n_b, n_groups, groups, links = make.of(value.as_py())
                sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                for c, v in zip(out, (n_a, n_b, n_groups, len(links), sha, *np.unique(links, return_counts=True))):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, out, kinds)],
                names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), whole_text(text_col).alias("text"))
    longs = ", ".join(f"{c} long" for c in ("row", "n_a", "n_b", "n_groups", "n_links"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, {longs}, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows each pair of ids is linked, and whether no pair of its first id is in more."""
    counts = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = write_table(counts, "pairs")
    own = F.shiftright("pair", 32)
    most = counts.groupBy(own.alias("a")).agg(F.max("n").alias("most"))
    marked = counts.withColumn("a", own).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return write_table(marked, "counts")


def frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs occur in that many rows or more."""
    by_size = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.bits - 1: r.n for r in by_size.collect()}  # at most 63 rows
    k, total = max(sizes, default=0) + 1, 0
    while k > 0 and total + sizes.get(k - 1, 0) <= most:
        k -= 1
        total += sizes.get(k, 0)
    return 1 << k


def summed(made: DataFrame, hot: pa.Table) -> DataFrame:
    """``made`` with n_best and count_sum over the pairs in ``hot``, and only the other pairs left."""
    hot = hot.sort_by("pair")
    hot_pair, hot_n = hot.column("pair").to_numpy(), hot.column("n").to_numpy()
    hot_best = hot.column("best").to_numpy().astype(np.int64)
    own = [c for c in made.columns if c not in ("pairs", "times")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("pairs"))
            pairs = lists.flatten().to_numpy()
            times = batch.column(batch.schema.get_field_index("times")).flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(hot_pair, pairs), max(len(hot_pair) - 1, 0))
            known = hot_pair[at] == pairs if len(hot_pair) else np.zeros(len(pairs), bool)
            sums = []
            for values in (hot_best, hot_n):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row[known], values[at[known]] * times[known])
                sums.append(pa.array(total))
            offsets = np.r_[0, np.cumsum(np.bincount(row[~known], minlength=batch.num_rows))].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[~known], pa.int64())) for v in (pairs, times)]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, *sums, *rest], names=[*own, "n_best", "count_sum", "pairs", "times"])

    fields = [f"`{c}` {made.schema[c].dataType.simpleString()}" for c in own]
    return made.mapInArrow(look_up, ", ".join([*fields, "n_best long", "count_sum long", "pairs array<long>", "times array<long>"]))


def aligned(
    docs: DataFrame, first: str = FIRST, second: str = SECOND, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that a tokenizer does not spell byte for byte, have no
    tokens: zeros and an empty ``groups_sha256``. Counts take every row as a document, repeated ones
    too. A null id is passed on; other columns are ignored.
    """
    columns_of(docs, id_col, text_col)
    made = write_table(measured(docs, first, second, id_col, text_col), "aligned")
    counts = pair_counts(made)
    least = frequent(counts, hot_pairs)
    sums = summed(made, counts.where(F.col("n") >= least).toArrow())  # at most ``hot_pairs`` rows
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:  # every pair went to the tasks
        return sums.select(out)
    sums = write_table(sums, "sums")
    rest = sums.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), "p.times")
    met = rest.join(counts.where(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum")
    )
    added = {c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))}
    return sums.join(met, "row", "left").withColumns(added).select(out)
