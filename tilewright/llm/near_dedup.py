"""Near-duplicates by b-bit MinHash.

1. One pass makes the shingle set of each text and from it a digest, ``bands * rows`` minima,
   the keys of the bands, and the low ``bits`` bits of every minimum, packed.
2. Texts with equal sets are one class; only class representatives go on.
3. Representatives that share a band key meet in a bucket. There the equal low bits are
   counted; corrected for chance they estimate the similarity. Pairs clearly below the
   threshold go; the others hold a cluster together.
4. The full sets decide, first along the edges that hold a cluster together: a text meets its
   neighbours one after the other. Where all hold, nothing is left to compare.
5. A cluster that falls into parts is compared between its parts, by counting common shingles.
6. Confirmed links form the components.

Buckets and clusters of more than ``block`` texts, or ``block_shingles`` shingles, are split
into blocks by a hash, and pairs of blocks are tasks' tiles, so no task holds more than two
blocks. A tile gives at most one edge per text it holds, so a family of near copies never turns
into a list of its pairs.

With 28 bands of 5 rows, two texts at the threshold of 0.8 miss each other in all bands with
probability 2e-5, and fall under the estimate's floor with 3e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import Cache, chained, columns_of, held, mixed, released, whole_text, word_hashes
from tilewright.llm.components import components
from tilewright.session import shuffle_slots, write_table


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80  # links need 100 * intersection >= percent * union
    bands: int = 28
    rows: int = 5
    bits: int = 4
    floor: float = 0.62  # pairs estimated below are no candidates
    block: int = 512
    block_shingles: int = 1 << 19

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class Sketcher:
    """Shingle sets and their sketches."""

    def __init__(self, s: Settings):
        self.s, self.memo = s, Cache(xxhash.xxh3_64_intdigest, limit=56 << 20)
        rng = np.random.default_rng(20_240)
        self.a = (rng.integers(0, 1 << 32, s.hashes, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, s.hashes, dtype=np.uint64).astype(np.uint32)[:, None]
        self.per_word = 64 // s.bits
        self.sig_words = -(-s.hashes // self.per_word)

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        span = min(self.s.words, len(words))
        return np.unique(chained(word_hashes(words, self.memo), tuple(range(1, span))))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.s.hashes, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 2048):
            out = np.minimum(out, (self.a * low[None, at : at + 2048] + self.b).min(axis=1))
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.s.bands, self.s.rows).astype(np.uint64)
        key = np.arange(self.s.bands, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.s.rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """Low bits of the minima, side by side in 64-bit words."""
        low = np.zeros(self.sig_words * self.per_word, np.uint64)
        low[: len(minima)] = minima & ((1 << self.s.bits) - 1)
        shifts = np.arange(self.per_word, dtype=np.uint64) * np.uint64(self.s.bits)
        return (low.reshape(-1, self.per_word) << shifts).sum(axis=1, dtype=np.uint64)

    def similarity(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Estimated similarity of a packed signature and each of many: equal fields, corrected for chance."""
        x = one ^ many
        step = 1
        while step < self.s.bits:
            x = x | (x >> np.uint64(step))
            step *= 2
        ones = np.uint64(sum(1 << k for k in range(0, 64, self.s.bits)))
        differ = np.bitwise_count(x & ones).sum(axis=1)
        chance = 0.5**self.s.bits
        return (1 - differ / self.s.hashes - chance) / (1 - chance)


def sketcher(s: Settings) -> Sketcher:
    return held(("near", s), lambda: Sketcher(s))


def sketches(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), band keys, packed signature."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = sketcher(s)
        for batch in batches:
            n, digests, keys, sigs = [], [], [], []
            for value in batch.column(1):
                shingles = sk.shingles(value.as_buffer().to_pybytes())
                n.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                minima = sk.minima(shingles)
                keys.append(sk.band_keys(minima) if len(shingles) else np.zeros(0, np.int64))
                sigs.append(sk.packed(minima).tobytes())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), batch.column(2)],
                names=["doc_id", "n_shingles", "high", "low", "keys", "signature", "code"],
            )

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("code"))
    columns = "doc_id long, n_shingles long, high long, low long, keys array<long>, signature binary, code long"
    return rows.mapInArrow(released(make), columns)


def tiled(members: DataFrame, group: str, blocks: Column, node: str) -> DataFrame:
    """Each member once for every tile of its group: ``i`` <= ``j`` are the blocks that meet, ``own`` is the member's."""
    count = F.greatest(F.ceil(blocks), F.lit(1)).cast("int")
    own = members.withColumn("own", F.pmod(F.xxhash64(node, group), count).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows of sorted batches, one tile (equal leading ``keys`` columns) at a time, as columns behind the keys."""
    now, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[:keys] != now:
                if held:
                    yield held
                now, held = row[:keys], [[] for _ in row[keys:]]
            for c, v in zip(held, row[keys:]):
                c.append(v)
    if held:
        yield held


def joined(n: int, links: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0..n-1 under ``links``: node and an array of its neighbours."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, others in links:
        for b in others.tolist():
            x, y = find(a), find(b)
            if x != y:
                root[y] = x
                out.append((a, b))
    return out


def edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def candidate_edges(tiles: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Estimate similarities inside each tile of a bucket; a spanning forest of what may be linked."""
    sk = sketcher(s)
    for block, ids, sizes, signatures in runs(tiles, 3):
        # The smallest id leads, so tiles of other bands find the same edges.
        order = np.argsort(np.array(ids), kind="stable").tolist()
        block, ids, sizes, signatures = ([c[k] for k in order] for c in (block, ids, sizes, signatures))
        sig = np.frombuffer(b"".join(signatures), np.uint64).reshape(len(ids), -1)
        n, side = np.array(sizes), np.array(block)
        cross = side.min() != side.max()

        def likely() -> Iterator[tuple[int, np.ndarray]]:
            for k in range(len(ids) - 1):
                near = sk.similarity(sig[k], sig[k + 1 :]) >= s.floor
                near &= 100 * np.minimum(n[k], n[k + 1 :]) >= s.percent * np.maximum(n[k], n[k + 1 :])
                if cross:
                    near &= side[k + 1 :] != side[k]
                yield k, k + 1 + np.flatnonzero(near)

        yield edge_batch([(ids[x], ids[y]) for x, y in joined(len(ids), likely())])


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the shingles that occur twice."""
    lengths = np.array([len(x) for x in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    shared = times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place[shared]]
    row, order = row[shared], np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for first in range(0, int((times > 1).sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part @ part.T
    return out


def star_edges(stars: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Compare the first text of each star, its middle, with the others, one at a time."""
    now, middle = None, np.zeros(0, np.uint64)
    for batch in stars:
        pairs = []
        for hub, share, leaf, node, data in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
            own = np.frombuffer(data.as_buffer(), np.uint64)
            if not leaf:
                now, middle = (hub, share), own.copy()
            elif now == (hub, share):
                both = len(np.intersect1d(middle, own, assume_unique=True))
                if 100 * both >= s.percent * (len(middle) + len(own) - both):
                    pairs.append((hub, node))
        yield edge_batch(pairs)


def confirmed_edges(tiles: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Compare full sets of different parts inside each tile of a cluster; a spanning forest of the links."""
    for block, ids, parts, data in runs(tiles, 3):
        sets = [np.frombuffer(x, np.uint64) for x in data]
        n, side, part = np.array([len(x) for x in sets]), np.array(block), np.array(parts)
        cross = side.min() != side.max()
        common = common_counts(sets)

        def linked() -> Iterator[tuple[int, np.ndarray]]:
            for k in range(len(ids) - 1):
                both = common[k, k + 1 :]
                link = (100 * both >= s.percent * (n[k] + n[k + 1 :] - both)) & (part[k + 1 :] != part[k])
                if cross:
                    link &= side[k + 1 :] != side[k]
                yield k, k + 1 + np.flatnonzero(link)

        yield edge_batch([(ids[x], ids[y]) for x, y in joined(len(ids), linked())])


def full_sets(docs: DataFrame, wanted: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``wanted`` (node, high, low and more) with the shingle ``set`` of the text that has this id and digest."""
    own = [c for c in wanted.columns if c not in ("high", "low")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = sketcher(s)
        for batch in batches:
            keep, sets = [], []
            for k, (value, high, low) in enumerate(zip(*(batch.column(c) for c in ("text", "high", "low")))):
                shingles = sk.shingles(value.as_buffer().to_pybytes()).tobytes()
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles), "<i8")
                if digest[0] == high.as_py() and digest[1] == low.as_py():
                    keep.append(k)
                    sets.append(shingles)
            kept = [batch.column(c).take(pa.array(keep, pa.int64())) for c in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sets, pa.binary())], names=[*own, "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), whole_text(text_col).cast("binary").alias("text"))
    # Hashing the narrow side spares sorting texts, and the plan is the same at every size.
    found = texts.join(wanted.hint("shuffle_hash"), "node").select(*wanted.columns, "text")
    columns = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in own)
    return found.mapInArrow(released(make), f"{columns}, set binary")


def near_duplicates(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, code (xxhash64 of the text as it is).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set holds the
    distinct shingles of ``words`` words, or the whole text as one if it has fewer. Texts are linked
    when 100 * intersection >= percent * union, and a component has the smallest id that
    can be reached. Null, empty and blank texts have no shingles and no links. Rows with a
    null id have the null component and are not kept. Other columns are ignored.
    """
    s = settings or Settings()
    columns_of(docs, id_col, text_col)
    slots = shuffle_slots(docs.sparkSession)
    made = write_table(sketches(docs, s, id_col, text_col), "sketches")
    classes = made.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("node"))
    classes = write_table(classes.where("node is not null"), "classes")
    known = made.select(F.col("doc_id").alias("node"), "high", "low", "n_shingles", "keys", "signature")
    reps = write_table(known.join(classes, ["node", "high", "low"], "left_semi").dropDuplicates(["node", "high", "low"]), "representatives")

    keys = reps.select("node", F.explode("keys").alias("key"))
    busy = write_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    members = keys.join(busy, "key").join(reps.select("node", "n_shingles", "signature"), "node")
    tiles = tiled(members, "key", F.col("size") / s.block, "node").select("key", "i", "j", "own", "node", "n_shingles", "signature")
    tiles = tiles.repartition(slots, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    likely = tiles.mapInArrow(released(lambda batches: candidate_edges(batches, s)), "a long, b long")
    likely = write_table(likely.distinct(), "likely")
    clusters = write_table(components(likely), "clusters")

    # Stars: a node and those of its neighbours that have greater ids, dealt in shares.
    edges = likely.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("node")).distinct()
    degree = edges.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / s.block).alias("shares"))
    leaves = edges.join(degree, "hub").select("hub", F.pmod(F.xxhash64("node"), "shares").alias("share"), F.lit(1).alias("leaf"), "node")
    shares = F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)
    middles = degree.select("hub", F.explode(shares).alias("share"), F.lit(0).alias("leaf"), F.col("hub").alias("node"))
    wanted = leaves.union(middles).join(classes, "node").select("hub", "share", "leaf", "node", "high", "low")
    stars = full_sets(docs, write_table(wanted, "stars"), s, id_col, text_col)
    stars = stars.repartition(slots, "hub", "share").sortWithinPartitions("hub", "share", "leaf")
    held_ = write_table(stars.mapInArrow(released(lambda batches: star_edges(batches, s)), "a long, b long"), "held")
    links = write_table(components(held_), "parts")

    nodes = clusters.join(links.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    nodes = nodes.join(reps.select("node", "high", "low", "n_shingles"), "node")
    nodes = write_table(nodes, "nodes")
    sizes = nodes.groupBy("component").agg(
        F.greatest(F.count(F.lit(1)) / s.block, F.sum("n_shingles") / s.block_shingles).alias("blocks"),
        F.min("part").alias("p"), F.max("part").alias("q"),
    )
    open_ = nodes.join(sizes.where("p < q").select("component", "blocks"), "component")  # clusters that fell into parts
    open_ = write_table(open_.select("node", "component", "part", "blocks", "high", "low"), "open")
    if not open_.isEmpty():
        found = full_sets(docs, open_, s, id_col, text_col)
        tiles = tiled(found, "component", F.col("blocks"), "node").select("component", "i", "j", "own", "node", "part", "set")
        tiles = tiles.repartition(slots, "component", "i", "j").sortWithinPartitions("component", "i", "j")
        links = components(held_.union(tiles.mapInArrow(released(lambda batches: confirmed_edges(batches, s)), "a long, b long")))

    lead = classes.join(links, "node", "left").select("high", "low", F.coalesce("component", "node").alias("lead"))
    lead = write_table(lead, "leads")
    rows = made.select("doc_id", "n_shingles", "high", "low", "code").join(lead, ["high", "low"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lead", "doc_id"))
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        "code",
    )
