from bisect import bisect_left
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tilewright.functions.scalar import toss
from tilewright.operators import evaluation as E
from tilewright.operators import experience as X
from tilewright.operators.layout import same_layout
from tilewright.operators.scan import SLICE, running, with_position, with_slices
from tilewright.session import local_table
from tilewright.sources.vectors import workload_table


@pytest.fixture(scope="module")
def rows(spark):
    """3,000 rows; half of them in one group, and the order values get sparser as they grow."""
    n = F.col("id")
    return spark.range(3000).select(
        "id",
        F.when(n % 2 == 0, 0).otherwise(n % 20).alias("g"),
        (n * n).alias("o"),
        ((n * 7919) % 101).cast("double").alias("v"),
    ).cache()


def values():
    return {
        "s": ("sum", F.col("v")),
        "c": ("count", F.lit(1)),
        "lo": ("min", F.col("v")),
        "hi": ("max", F.col("v")),
        "last": ("last", F.when(F.col("id") % 3 == 0, F.col("v"))),
    }


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("inclusive", [True, False])
def test_sliced_running_values_equal_plain_ones(rows, by, inclusive):
    plain = running(rows, by, "o", values(), inclusive, slices=1)
    sliced = running(rows, by, "o", values(), inclusive, slices=32)
    assert plain.count() == 3000 and same_layout(plain, sliced, plain.columns)


@pytest.mark.parametrize("spacing", ["id", "pow(1.02D, id)", "o"])
def test_slices_keep_order_and_stay_small(rows, spacing):
    rows = rows.withColumn("o", F.expr(spacing).cast("double"))
    sliced = with_slices(rows, F.col("o"), 32)
    sizes = sliced.groupBy(SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 and sizes.count() == 32
    ends = sliced.groupBy(SLICE).agg(F.min("o").alias("a"), F.max("o").alias("b")).collect()
    for p in ends:
        assert all(p.b < q.a for q in ends if q[SLICE] > p[SLICE])


def plain_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def test_running_values_start_no_job_and_gather_no_rows(spark, rows):
    spark.sparkContext.setJobGroup("lazy", "lazy")
    made = [
        running(rows, [], "o", values()),
        X.rolling_mean(rows, "o", "v", 7),
        X.match_streak(rows, "o", F.col("v") > 3, 5),
        X.retain_latest(rows, 10, ["g"], "o"),
        X.initial_priority(rows.select(F.col("id").alias("idx"), F.col("v").alias("priority")), "idx"),
        E.improvement_count(E.best_so_far(rows.selectExpr("id AS seq", "1 AS layout_id", "v AS cost", "'ok' AS status"))),
    ]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString()
        # Windows are by slice; the only single task adds up sketches of quantiles.
        for k, line in enumerate(plan.splitlines()):
            if "Exchange SinglePartition" in line:
                assert "Aggregate(key" in plan.splitlines()[k + 1]  # sketches, a least value, or a row per slice
        assert "Window" in plan and "windowspecdefinition(o" not in plan.replace(" ", "")


def test_null_keys_and_null_orders(spark):
    table = local_table(spark, [(None, 1, 2.0), (None, None, 1.0), (1, 2, 5.0), (1, 3, 7.0)], "g int, o int, v double")
    got = running(table, ["g"], "o", {"s": ("sum", F.col("v"))}, slices=4).collect()
    assert {(r.g, r.o): r.s for r in got} == {(None, None): 1.0, (None, 1): 3.0, (1, 2): 5.0, (1, 3): 12.0}
    assert X.retain_latest(table, 1, ["g"], "o", slices=4).count() == 2


def test_positions(rows):
    got = with_position(rows, ["g"], "o", slices=32).groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("top")
    )
    assert all(r.n == r.d == r.top + 1 for r in got.collect())


def test_rolling_mean(spark, rows):
    four = local_table(spark, [(k, float(k)) for k in (1, 2, 3, 4)], "t int, v double")
    assert [r.rolling_mean for r in X.rolling_mean(four, "t", "v", 3).orderBy("t").collect()] == [None, None, 2, 3]
    assert [r.rolling_mean for r in X.rolling_mean(four, "t", "v", 1).orderBy("t").collect()] == [1, 2, 3, 4]
    whole = X.rolling_mean(rows, "o", "v", 7, by=["g"])
    parts = X.rolling_mean(rows, "o", "v", 7, by=["g"], limit=64)
    assert same_layout(whole, parts, whole.columns)


def test_nstep_return(spark):
    steps = [(1, k, float(k == 6), k == 6, [float(k)], [k + 1.0]) for k in range(7)]
    ddl = "episode bigint, step bigint, reward double, done boolean, state array<double>, next_state array<double>"
    table = local_table(spark, steps, ddl)
    for limit in (10_000, 3):
        got = X.nstep_return(table, 3, 0.99, limit).orderBy("step").collect()
        assert [round(r.nstep_reward, 6) for r in got] == [0, 0, 0, 0, 0.9801, 0.99, 1]
        assert [r.next_state for r in got] == [[3.0], [4.0], [5.0], [6.0], None, None, None]
    # An unfinished episode has no incomplete sums.
    unfinished = table.withColumn("done", F.lit(False))
    assert X.nstep_return(unfinished, 3, 0.99).count() == 5


def test_streak_stops_at_patience(spark):
    hits = [True, True, False, True, True, True, True]
    table = local_table(spark, list(enumerate(hits)), "t int, hit boolean")
    got = X.match_streak(table, "t", F.col("hit"), 3).orderBy("t").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 3]
    assert X.match_streak(table, "t", F.col("hit"), 9).count() == 7
    sliced = X.match_streak(table, "t", F.col("hit"), 3, slices=4).orderBy("t").collect()
    assert [r.streak for r in sliced] == [1, 2, 0, 1, 2, 3]


def test_retention(rows):
    plain = X.retain_latest(rows, 120, ["g"], "o", slices=1)
    sliced = X.retain_latest(rows, 120, ["g"], "o", slices=64)
    assert same_layout(plain, sliced, plain.columns)
    sizes = {r.g: (r.n, r.low) for r in plain.groupBy("g").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
    assert sizes[0] == (120, 2998 - 2 * 119)


def test_every_kth(rows):
    assert X.every_kth(rows, "id", 100).count() == 30
    assert X.every_kth(rows, "id", 100, offset=0).agg(F.min("id")).first()[0] == 0


def test_initial_priority(spark):
    table = local_table(spark, [(0, 0.0), (1, 0.4), (2, 0.2)], "idx int, priority double")
    assert X.initial_priority(table).first().priority == 0.4
    assert X.initial_priority(table.filter("idx < 0")).first().priority == 1.0
    got = X.initial_priority(table, "idx").orderBy("idx").collect()
    assert [r.initial_priority for r in got] == [1.0, 1.0, 0.4]


def test_lookup_takes_the_first_row_that_reaches_the_draw(spark):
    weights = local_table(spark, [(0, 1.0), (1, 0.0), (2, 2.0), (3, 1.0)], "idx int, priority double")
    draws = local_table(spark, [(k, s) for k, s in enumerate((0.0, 1.0, 1.5, 3.0, 3.2, 4.0))], "draw int, s double")
    for slices in (1, 4, 64):
        got = {r.draw: r.idx for r in X.weighted_lookup(draws, weights, slices).collect()}
        assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 3, 5: 3}
    assert X.weighted_lookup(draws.limit(0), weights).collect() == []
    assert X.weighted_lookup(draws, weights.limit(0)).collect() == []


def test_lookup_with_one_priority_above_all_others(spark):
    n = 20_000
    weights = spark.range(n).select(F.col("id").alias("idx"), F.when(F.col("id") == 7000, 1e12).otherwise(F.col("id") % 3).cast("double").alias("priority"))
    draws = spark.range(3000).select(F.col("id").alias("draw"), (F.col("id") * (1e12 / 2990)).alias("s"))
    small = spark.range(200).select((F.col("id") + 5000).alias("draw"), (F.col("id") * 30.0).alias("s"))
    draws = draws.unionByName(small).unionByName(draws.limit(1).select((F.col("draw") + 9000).alias("draw"), F.lit(50.0).alias("s")))
    got = {r.draw: r.idx for r in X.weighted_lookup(draws, weights, 64).collect()}
    priorities = [1e12 if k == 7000 else float(k % 3) for k in range(n)]
    reach = list(accumulate(priorities))
    want = {r.draw: bisect_left(reach, r.s) for r in draws.collect() if r.s <= reach[-1]}
    assert got == want


def test_a_mixed_batch_reads_its_memories_a_few_times(spark, tmp_path):
    path = str(tmp_path / "memory")
    spark.range(1000).selectExpr("id AS idx", "id % 7 + 0.5D AS priority", "id % 3 = 0 AS is_demo").write.parquet(path)
    reads = []
    rows = spark.read.parquet(path)
    shared = X.cumulative(rows, F.when(F.col("is_demo"), F.lit("demo")).otherwise("agent"))
    draws = X.spread_draws(spark, "demo", shared.total("demo"), 8, 1).unionByName(X.spread_draws(spark, "agent", shared.total("agent"), 24, 2))
    plan = X.lookup(draws, shared)._jdf.queryExecution().executedPlan().toString()
    reads.append(len({line.strip(" :+-*()0123456789") for line in plan.splitlines() if "FileScan parquet" in line}))
    batch = X.mixed_batch(rows.filter("is_demo"), rows.filter("NOT is_demo"))
    reads.append(batch._jdf.queryExecution().executedPlan().toString().count("FileScan parquet"))
    assert reads[0] <= 4 and reads[1] == 0, reads


def test_priority_sample(spark):
    table = spark.range(1000).select(
        F.col("id").alias("idx"), F.when(F.col("id") == 500, 333.0).otherwise(1 / 3).alias("priority")
    )
    picked = X.priority_sample(table, 200, 1000, progress=0.5, seed=5)
    rows = picked.collect()
    assert len(rows) == 200 and rows == X.priority_sample(table, 200, 1000, progress=0.5, seed=5).collect()
    assert max(r.weight for r in rows) == 1.0
    share = sum(r.idx == 500 for r in rows) / 200
    assert 0.35 < share < 0.65
    low = next(r for r in rows if r.idx == 500)
    assert low.weight == pytest.approx((333.0 / (1 / 3)) ** -0.7)


def test_uniform_sample_and_batches(spark):
    table = spark.range(500).select(F.col("id").alias("idx"), F.lit(1.0).alias("priority"))
    one = X.sample_k(table, 32, 1, key="idx").collect()
    assert len({r.idx for r in one}) == 32 and {r.weight for r in one} == {1.0}
    assert one == X.sample_k(table, 32, 1, key="idx").collect()
    assert one != X.sample_k(table, 32, 2, key="idx").collect()
    for prioritized in (True, False):
        batch = X.mixed_batch(table.filter("idx < 5"), table.filter("idx >= 5"), 32, 0.25, prioritized=prioritized)
        sizes = {r.source: r["count"] for r in batch.groupBy("source").count().collect()}
        assert sizes == {"demo": 5, "agent": 27}


@pytest.mark.parametrize("k", [0, 1, 700, 2999, 3000, 5000])
def test_large_samples_are_the_lowest_tosses(spark, k):
    table = spark.range(3000).select(F.col("id").alias("idx"), F.lit(1.0).alias("priority"))
    want = {r.idx for r in table.orderBy(toss(5, "idx"), "idx").limit(k).collect()}
    got = [r.idx for r in X.sample_k(table, k, 5, key="idx").collect()]
    assert len(got) == len(want) and set(got) == want


def test_priorities_are_written_back(spark):
    table = local_table(spark, [(0, 1.0), (1, 2.0)], "idx int, priority double")
    errors = local_table(spark, [(1, -3.0)], "idx int, td_error double")
    got = {r.idx: r.priority for r in X.update_priorities(table, errors).collect()}
    assert got == {0: 1.0, 1: pytest.approx(3.0001**0.6)}


def test_transitions_are_routed(spark):
    steps = local_table(spark, [(1, 0, False), (1, 1, False), (2, 0, True)], "episode int, step int, is_demo boolean")
    evals = local_table(spark, [(1, True), (2, False)], "episode int, improved boolean")
    got = {(r.episode, r.step): r.is_demo for r in X.route_transitions(steps, evals).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): False}


def test_costs_and_records(spark):
    workload = workload_table(spark, [500, 1000], [0.25, 0.75])
    runs = [
        (0, 0, 0, 3.0, "ok"), (0, 0, 1, 1.0, "ok"), (0, 0, 2, 2.0, "ok"), (0, 1, 0, 4.0, "ok"),
        (1, 0, 0, 1.0, "ok"), (1, 1, 0, 9.0, "ok"), (1, 1, 1, 30.0, "aborted"),
        (2, 0, 0, 1.0, "ok"), (2, 1, 0, 2.0, "ok"),
        (3, 0, 0, 1.0, "ok"), (3, 1, 0, 3.0, "ok"),
    ]
    trials = local_table(spark, runs, "layout_id int, qid int, trial int, seconds double, status string")
    costs = E.median_cost(trials)
    assert {(r.layout_id, r.qid): r.seconds for r in costs.collect()} == {
        (0, 0): 2.0, (0, 1): 4.0, (1, 0): 1.0, (1, 1): None, (2, 0): 1.0, (2, 1): 2.0, (3, 0): 1.0, (3, 1): 3.0,
    }
    evals = E.workload_cost(costs, workload).withColumn("seq", F.col("layout_id"))
    assert E.total_query_time(trials).first().seconds == 57.0
    for slices in (1, 4):
        marked = {r.seq: r for r in E.best_so_far(evals, slices).collect()}
        assert [marked[k].cost for k in range(4)] == [3.5, None, 1.75, 2.5]
        assert [marked[k].status for k in range(4)] == ["ok", "aborted", "ok", "ok"]
        assert [marked[k].best_before for k in range(4)] == [None, 3.5, 3.5, 1.75]
        assert [marked[k].improved for k in range(4)] == [False, False, True, False]
        assert [marked[k].reward for k in range(4)] == [1.0, 0.2, 4.0, pytest.approx(0.49)]
        counts = E.improvement_count(E.best_so_far(evals, slices), slices).orderBy("seq").collect()
        assert [r.improvements for r in counts] == [0, 0, 1, 1]
        budgets = {(r.seq, r.qid): r.budget for r in E.best_costs_so_far(costs, evals, slices).collect()}
        assert budgets == {
            (0, 0): None, (0, 1): None, (1, 0): 2.0, (1, 1): 4.0, (2, 0): 2.0, (2, 1): 4.0, (3, 0): 1.0, (3, 1): 2.0,
        }
    all_stopped = local_table(spark, [(5, 0, 0, 9.0, "aborted")], "layout_id int, qid int, trial int, seconds double, status string")
    stopped = E.workload_cost(E.median_cost(trials.unionByName(all_stopped)), workload).filter("layout_id = 5").collect()
    assert [(r.cost, r.status) for r in stopped] == [(None, "aborted")]


def test_rolling_blocks_fit_a_task(spark):
    """Two million rows are windowed in several blocks, none above half a million rows of its own and the reach."""
    log = spark.range(2_000_000).select(F.col("id").alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    blocks = X.with_blocks(log, "t", 9, X.BLOCK_ROWS, before=True).groupBy("_block").count().collect()
    assert len(blocks) >= 4 and max(r["count"] for r in blocks) <= 500_009
    wrong = X.rolling_mean(log, "t", "v", 7).filter("t >= 6 AND rolling_mean <> 3 OR t < 6 AND rolling_mean IS NOT NULL")
    assert wrong.count() == 0
