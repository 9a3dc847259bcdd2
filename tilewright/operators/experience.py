"""Operators over experience and log tables: returns, retention, streaks, priority sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions.scalar import TOSSES, priority, toss
from tilewright.operators import scan
from tilewright.operators.scan import running, with_blocks, with_position
from tilewright.session import BLOCK_ROWS, pin, write_table

# Fixed value: weight of the importance correction at the start of a run.
BETA_START = 0.4

# Bins of tosses; a sample ranks the rows of one of them.
TOSS_BINS = 1 << 16

LOG_SUMS = ("reward", "loss_n", "loss_e", "loss_l2", "loss_all")


def rolling_mean(
    df: DataFrame, order: str, col: str, n: int, by: Sequence[str] = (), out: str = "rolling_mean",
    limit: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of the last n rows; null until n rows have been seen. Windows run over blocks of ``limit`` rows."""
    placed = with_position(df, by, order, "_pos")
    blocks = with_blocks(placed, "_pos", n - 1, limit, before=True)
    frame = W.partitionBy(*by, "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    mean = F.when(F.col("_pos") >= n - 1, F.avg(col).over(frame))
    return blocks.withColumn(out, mean).filter("_own").select(*df.columns, out)


def nstep_return(transitions: DataFrame, n: int = 3, gamma: float = 0.99, limit: int = BLOCK_ROWS) -> DataFrame:
    """Add ``nstep_reward`` and the next state n steps on.

    The sum stops at the terminal step, and the next state is then null. Rows
    too close to the end of an unfinished episode are left out. ``step`` counts
    0, 1, 2, ... within an episode.
    """
    blocks = with_blocks(transitions, "step", n - 1, limit, before=False)
    frame = W.partitionBy("episode", "_block").orderBy("step").rowsBetween(0, n - 1)
    has_state = "next_state" in transitions.columns
    added = {"_ahead": F.collect_list(F.struct("reward", "done")).over(frame)}
    if has_state:
        added["_last"] = F.lead("next_state", n - 1).over(W.partitionBy("episode", "_block").orderBy("step"))
    ahead = blocks.withColumns(added).filter("_own")
    stop = F.array_position(F.transform("_ahead", lambda r: r["done"]), True)
    ended = stop > 0
    kept = F.when(ended, F.slice("_ahead", F.lit(1), stop)).otherwise(F.col("_ahead"))
    total = F.aggregate(
        kept,
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("weight")),
        lambda a, r: F.struct(
            (a["sum"] + r["reward"] * a["weight"]).alias("sum"),
            (a["weight"] * gamma).alias("weight"),
        ),
        lambda a: a["sum"],
    )
    result = ahead.filter(ended | (F.size("_ahead") == n)).withColumn("nstep_reward", total)
    if has_state:
        result = result.withColumn("next_state", F.when(~ended, F.col("_last")))
    return result.select(*transitions.columns, "nstep_reward")


def episode_totals(steps: DataFrame) -> DataFrame:
    """Totals of reward and losses per episode, for the loss columns that are present."""
    sums = [F.sum(c).alias(c) for c in LOG_SUMS if c in steps.columns]
    return steps.groupBy("episode").agg(*sums)


def every_kth(df: DataFrame, order: str, k: int, offset: int = 1) -> DataFrame:
    """Keep every k-th row of a numbered log."""
    return df.filter((F.col(order) + offset) % k == 0)


def match_streak(df: DataFrame, order: str, match: Column, patience: int, slices: int | None = None) -> DataFrame:
    """Add ``streak``, the run of consecutive matches, and stop once it reaches ``patience``."""
    found = scan.streaks(df, order, match, "streak", slices)
    stop = found.where(F.col("streak") >= patience).agg(F.min(order)).scalar()
    return found.where(stop.isNull() | (F.col(order) <= stop))


def retain_latest(df: DataFrame, capacity: int, by: Sequence[str], order: str, slices: int | None = None) -> DataFrame:
    """Keep the newest ``capacity`` rows of each group.

    Slices that lie wholly behind the newest ``capacity`` rows of a group are dropped by
    their counts, before any row is ranked.
    """
    return scan.newest(df, by, order, capacity, slices)


def initial_priority(df: DataFrame, order: str | None = None, slices: int | None = None) -> DataFrame:
    """Priority a new row gets: the largest one stored, 1 when there is none.

    One row for the table as it is; with ``order``, a column with the value each
    row would have got when it arrived.
    """
    if order is None:
        return df.agg(F.coalesce(F.nullif(F.max("priority"), F.lit(0.0)), F.lit(1.0)).alias("priority"))
    stored = running(df, [], order, {"_top": ("max", F.col("priority"))}, inclusive=False, slices=slices)
    top = F.coalesce(F.nullif(F.col("_top"), F.lit(0.0)), F.lit(1.0))
    return stored.withColumn("initial_priority", top).drop("_top")


def sample_k(df: DataFrame, k: int, seed: int, key: str = "id") -> DataFrame:
    """Uniform sample of k rows without replacement, weight 1; the same rows for the same seed.

    The k rows with the lowest toss. Their range ends in one of ``TOSS_BINS`` bins of tosses, found
    from the sizes of the bins: rows of the bins before it are taken as they are, and only those of that
    bin are ranked. All rows if there are no more than k.
    """
    value = toss(seed, key)
    binned = df.withColumns({"_toss": value, "_bin": F.floor(value / (TOSSES // TOSS_BINS))})
    sizes = binned.groupBy("_bin").agg(F.count("*").alias("n"))  # at most TOSS_BINS rows
    upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_bin"))
    ends = sizes.select("_bin", upto.alias("upto"), (upto - F.col("n")).alias("before")).where(F.col("upto") >= k)
    end = ends.agg(F.min(F.struct("_bin", "before"))).scalar()
    near = binned.withColumn("_end", end)
    last = F.col("_end._bin")
    whole = near.where(last.isNull() | (F.col("_bin") < last)).select(df.columns)
    rank = F.row_number().over(W.partitionBy("_bin").orderBy("_toss", key))
    part = near.where(F.col("_bin") == last).withColumn("_rank", rank)
    part = part.where(F.col("_rank") + F.col("_end.before") <= k).select(df.columns)
    return whole.unionByName(part).withColumn("weight", F.lit(1.0))


@dataclass(frozen=True)
class Cumulative:
    """Running priority sums of one or several memories, written once and read by every draw from them.

    ``rows`` has memory, idx, priority, cum. ``ends`` has, per memory, the total and the first
    row that reaches it.
    """

    rows: DataFrame
    ends: dict[str, tuple[float, int, float]]

    def total(self, memory: str) -> float:
        return self.ends[memory][0] if memory in self.ends else 0.0


def cumulative(weights: DataFrame, memory: Column | None = None, slices: int | None = None) -> Cumulative:
    """Running sums of (idx, priority) in idx order, for each value of ``memory``."""
    rows = weights.select((F.lit("") if memory is None else memory).alias("memory"), "idx", "priority")
    summed = running(rows, ["memory"], "idx", {"cum": ("sum", F.col("priority"))}, slices=slices)
    table = write_table(summed, "cumulative")
    reach = F.min_by(F.struct("cum", "idx", "priority"), F.struct(-F.col("cum"), F.col("idx")))
    ends = table.where("cum IS NOT NULL").groupBy("memory").agg(reach.alias("end")).collect()  # a row per memory
    return Cumulative(table, {r.memory: tuple(r.end) for r in ends})


def lookup(draws: DataFrame, table: Cumulative, slices: int | None = None) -> DataFrame:
    """(memory, draw, s, idx, priority): the first row, in idx order, of the memory whose cumulative priority reaches s.

    Rows and distinct draws are merged in falling order of their values: a draw's row is the
    last one before it. Both are cut into slices at common quantiles, so a row that
    takes nearly all draws is no burden, and neither is a value drawn very often. A value above the total by no
    more than rounding errors hits the row that reaches the total.
    """
    wanted = draws.select("memory", "s").distinct()
    merged = table.rows.where("cum IS NOT NULL").select(
        "memory", F.struct((-F.col("cum")).alias("v"), F.lit(0).alias("kind"), (-F.col("idx")).cast("bigint").alias("i")).alias("place"),
        F.struct("idx", "priority").alias("row"),
    )
    values = wanted.select(
        "memory", F.struct((-F.col("s")).alias("v"), F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("i")).alias("place"),
        F.lit(None).cast(merged.schema["row"].dataType).alias("row"),
    )
    both = merged.unionByName(values)
    found = running(both, ["memory"], "place", {"hit": ("last", F.col("row"))}, slices=slices, at=F.col("place.v"))
    hits = found.where("place.kind = 1").select("memory", (-F.col("place.v")).alias("s"), "hit")
    last = F.lit(None).cast(merged.schema["row"].dataType)
    for memory, (total, idx, priority_) in table.ends.items():
        near = (F.col("memory") == memory) & (F.col("s") <= total * (1 + 1e-12))
        row = F.struct(F.lit(idx).cast(merged.schema["row"].dataType["idx"].dataType).alias("idx"), F.lit(priority_).alias("priority"))
        last = F.when(near, row).otherwise(last)
    hits = hits.withColumn("hit", F.coalesce("hit", last)).where("hit IS NOT NULL")
    return draws.join(hits, ["memory", "s"]).select("memory", "draw", "s", "hit.*")


def weighted_lookup(draws: DataFrame, weights: DataFrame, slices: int | None = None) -> DataFrame:
    """(draw, s, idx, priority): the first row, in idx order, whose cumulative priority reaches s."""
    wanted = draws.select(F.lit("").alias("memory"), "draw", "s")
    return lookup(wanted, cumulative(weights, slices=slices), slices).drop("memory")


def importance(hits: DataFrame, totals: Mapping[str, float], capacities: Mapping[str, int], progress: float) -> DataFrame:
    """Add ``weight``: (capacity * p / total) ^ -beta, scaled so that the largest of a memory is 1.

    Beta grows from its start value to 1 with ``progress`` from 0 to 1. The hits are fixed first, as
    their largest weight is looked up among them.
    """
    beta = BETA_START + (1 - BETA_START) * progress
    share = F.lit(None).cast("double")
    for memory, total in totals.items():
        own = F.lit(float(capacities[memory])) * F.col("priority") / F.lit(total)
        share = F.when(F.col("memory") == memory, own).otherwise(share)
    raw = pin(hits.withColumn("_raw", F.pow(share, F.lit(-beta))))
    top = raw.groupBy("memory").agg(F.max("_raw").alias("_top"))
    return raw.join(top, "memory").withColumn("weight", F.col("_raw") / F.col("_top")).drop("_raw", "_top")


def spread_draws(spark: SparkSession, memory: str, total: float, k: int, seed: int) -> DataFrame:
    """(memory, draw, s): k values spread uniformly over a total priority, fixed by the seed."""
    u = (toss(seed, "id") + 0.5) / float(TOSSES)
    return spark.range(k).select(F.lit(memory).alias("memory"), F.col("id").alias("draw"), (u * F.lit(total)).alias("s"))


def sample_at(df: DataFrame, draws: DataFrame, capacity: int, progress: float, slices: int | None = None) -> DataFrame:
    """Rows hit by given draws, with importance weights."""
    table = cumulative(df, slices=slices)
    hits = lookup(draws.select(F.lit("").alias("memory"), "draw", "s"), table, slices)
    return importance(hits, {"": table.total("")}, {"": capacity}, progress).drop("memory")


def priority_sample(
    df: DataFrame, k: int, capacity: int, progress: float = 0.0, seed: int = 0, slices: int | None = None
) -> DataFrame:
    """k rows of df(idx, priority) with replacement, chosen in proportion to priority."""
    table = cumulative(df, slices=slices)
    hits = lookup(spread_draws(df.sparkSession, "", table.total(""), k, seed), table, slices)
    return importance(hits, {"": table.total("")}, {"": capacity}, progress).drop("memory")


def update_priorities(df: DataFrame, td_errors: DataFrame) -> DataFrame:
    """Replace the priority of the rows listed in td_errors(idx, td_error)."""
    fresh = td_errors.select("idx", priority(F.col("td_error")).alias("_fresh"))
    return df.join(fresh, "idx", "left").select(
        *[
            F.coalesce("_fresh", "priority").alias("priority") if c == "priority" else F.col(c)
            for c in df.columns
        ]
    )


def mixed_batch(
    demo: DataFrame, agent: DataFrame, batch: int = 32, demo_ratio: float = 0.25, demo_capacity: int = 100,
    agent_capacity: int = 10_000, progress: float = 0.0, seed: int = 0, prioritized: bool = True,
) -> DataFrame:
    """A batch with ``int(batch * demo_ratio)`` demonstration rows, fewer if fewer exist, rest from agent rows.

    Draws by priority share one table of running sums for both memories.
    """
    n_demo = demo.limit(int(batch * demo_ratio)).count()
    if not prioritized:
        picked = [sample_k(df, k, s, key="idx").withColumn("source", F.lit(name)) for df, k, s, name in (
            (demo, n_demo, seed, "demo"), (agent, batch - n_demo, seed + 1, "agent"))]
        return picked[0].select("idx", "priority", "weight", "source").unionByName(
            picked[1].select("idx", "priority", "weight", "source")
        )
    both = [df.select("idx", "priority", F.lit(name).alias("memory")) for df, name in ((demo, "demo"), (agent, "agent"))]
    table = cumulative(both[0].unionByName(both[1]), F.col("memory"))
    totals = {name: table.total(name) for name in ("demo", "agent")}
    spark = demo.sparkSession
    draws = spread_draws(spark, "demo", totals["demo"], n_demo, seed).unionByName(
        spread_draws(spark, "agent", totals["agent"], batch - n_demo, seed + 1)
    )
    hits = importance(lookup(draws, table), totals, {"demo": demo_capacity, "agent": agent_capacity}, progress)
    return hits.select("idx", "priority", "weight", F.col("memory").alias("source"))


def route_transitions(transitions: DataFrame, evals: DataFrame) -> DataFrame:
    """Set ``is_demo``: transitions of improved episodes go to the demonstrations, others to the agent rows."""
    better = evals.filter("improved").select("episode").distinct().withColumn("_better", F.lit(True))
    joined = transitions.drop("is_demo").join(pin(better), "episode", "left")
    return joined.withColumn("is_demo", F.coalesce("_better", F.lit(False))).drop("_better")
