import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import config
from granary.functions import expr as X
from granary.operators import evaluate, features, prep, retention, rounds, stateful, vectors
from granary.plans import sweep
from granary.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,value", [(" 1.5 ", 1.5), ("", 0.0), (None, 0.0), ("abc", 0.0), ("True", 0.0), ("NaN", 0.0), ("Infinity", 0.0), ("1e400", 0.0), ("1d", 1.0)])
def test_safe_double(spark, text, value):
    assert one(spark, X.safe_double(F.lit(text))) == value


def test_scalar_functions(spark):
    assert one(spark, X.signed_log(F.lit(-1.0))) == pytest.approx(-math.log(2))
    assert one(spark, X.l2(F.array(F.lit(0.0), F.lit(3.0)).cast("array<float>"), F.array(F.lit(4.0), F.lit(0.0), F.lit(9.0)).cast("array<float>"))) == 5.0
    assert one(spark, X.payload_bytes(F.lit("é"), F.lit(None), F.lit("ab"))) == 28
    assert one(spark, X.version_id(F.lit(3), F.lit(5))) == (3 << 48) + 5
    assert one(spark, X.key_of(F.lit("x"), F.lit(7))) == 7 and one(spark, X.key_of(F.lit(" 12 "), F.lit(7))) == 12


def test_utilities(spark):
    none = F.lit(None).cast("double")
    utility = lambda d, load, mean, target: one(spark, X.store_utility(F.lit(d), F.lit(load), mean, F.lit(target), 1.0, 0.5, 2.0))
    assert utility(2.0, 3, F.lit(4.0), 3.0) == 0.5  # balance 1
    assert utility(2.0, 0, F.lit(4.0), 9.0) == 1.0  # balance stops at 2
    assert utility(2.0, 3, none, 3.0) == 2.0
    assert utility(float("inf"), 3, F.lit(1.0), 3.0) == float("inf")
    assert utility(-1.0, 0, F.lit(0.0), 1.0) == 0.0
    rep = lambda a, b: one(spark, X.rep_utility(F.lit(a), F.lit(b)))
    assert rep(1.0, 2.0) == pytest.approx(math.log(2) * 1.125)
    assert rep(1.0, float("inf")) == pytest.approx(math.log(2)) and rep(float("inf"), 1.0) == float("inf") and rep(0.0, 0.0) == 0.0


def test_config():
    assert (config.budget(1001, 0.1), config.budget(0, 0.5)) == (101, 1)
    assert [config.max_representatives(b) for b in (1, 2, 3, 100)] == [1, 1, 1, 10]
    assert config.overlay_sizes(8) == (7, 5) and config.overlay_sizes(5) == (4, 4) and config.overlay_sizes(1) == (1, 1)
    for wrong in ({"mode": "x"}, {"nodes": 0}, {"nodes": 37}, {"ratios": (0.0,)}, {"transform": "x"}, {"balance_min": 3.0}):
        with pytest.raises(ValueError):
            config.RetentionConfig(**wrong)
    assert config.RetentionConfig.load('{"nodes": 5, "ratios": [0.1, 0.2]}').ratios == (0.1, 0.2)
    with pytest.raises(ValueError):
        config.RetentionConfig.load('{"nodez": 5}')


def test_sequence_numbers_gaps_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(features, "SEQ_BUCKET", 4)
    df = spark.createDataFrame([(k,) for k in (9, 3, 4, 17, 0, -5)], "k long")
    assert [(r.k, r.seq) for r in features.with_seq(df, "k").orderBy("k").collect()] == [(k, i) for i, k in enumerate((-5, 0, 3, 4, 9, 17))]


def test_fit_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([("2", "x"), ("2", "5")], "a string, b string")
    stats = features.fit_row(df, ["a", "b"], log=False)
    assert stats["a"] == (2.0, 1.0, 2.0, 1.0) and stats["b"][:2] == (2.5, 2.5)
    assert features.fit_row(df.limit(0), ["a"], log=True)["a"] == (0.0, 1.0, 0.0, 1.0)


def test_two_nearest_ties_and_unsound_vectors(spark):
    rows = [(0, 1, [0.0]), (0, 2, [0.0]), (0, 3, [4.0]), (0, 4, [float("nan")]), (0, 5, [1.0])]
    items = spark.createDataFrame(rows, "node int, key long, vector array<float>")
    reps = vectors.representatives(items, 4)
    out = {r.key: r for r in vectors.two_nearest(items, reps).collect()}
    assert (out[5].k1, out[5].d1, out[5].k2) == (1, 1.0, 2) and (out[1].k1, out[1].k2) == (2, 3) and out[4].k1 is None
    with pytest.raises(ValueError):
        vectors.representatives(items, vectors.REPS_LIMIT + 1)


def test_uniform_sample_is_nested_and_fair(spark):
    items = spark.range(4000).selectExpr("id AS key", "cast(id % 4 as int) AS node")
    small, large = ({(r.node, r.key) for r in retention.uniform(items, n).collect()} for n in (50, 200))
    assert small < large and len(small) == 200 and len(large) == 800
    keys = [k for _, k in large]
    assert abs(sum(keys) / len(keys) - 2000) < 150


def make(n, dim=4, seed=0):
    return np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)


@pytest.mark.parametrize("capacity,reps", [(2, 1), (3, 1), (20, 4), (60, 7), (500, 10)])
def test_state_machine_invariants(capacity, reps):
    state, live = stateful.UtilityNode(capacity, reps), set()
    admitted = evicted = 0
    for key, v in enumerate(make(300)):
        d = state.offer(key, v)
        before = set(state.reps)
        if d.kind != "DROPPED":
            admitted += 1
            live.add(key)
        if d.evicted is not None:
            evicted += 1
            assert d.evicted in live and d.evicted not in before
            live.remove(d.evicted)
        assert live == set(state.reps) | set(state.others) and len(live) <= capacity and len(state.reps) <= reps
        assert sum(b.load for b in state.bins.values()) == sum(x.near is not None for x in state.others.values())
    assert admitted - evicted == len(live) == min(capacity, 300)
    with pytest.raises(ValueError):
        state.offer(next(iter(live)), make(1)[0])


def test_reservoir_is_fair():
    counts = np.zeros(40)
    for seed in range(400):
        node = stateful.ReservoirNode(10, seed)
        for key in range(40):
            node.offer(key)
        counts[node.kept] += 1
    assert abs(counts / 400 - 0.25).max() < 0.1


def test_sequential_batch_form(spark, sf):
    from granary.plans import registry

    events = registry.utility_events(spark, sf).cache()
    kept = stateful.stored(events)
    assert kept.groupBy("node").count().where("count > 50").count() == 0
    assert kept.count() == events.where("kind = 'ADMITTED'").count()
    assert events.count() == 500


def test_stream_equals_batch(spark, sf):
    from granary.plans import registry

    batch = {(r.node, r.key, r.kind) for r in registry.utility_events(spark, sf).collect()}
    assert {(r.node, r.key, r.kind) for r in registry.QUERIES["stream_retention"](spark, sf).collect()} == batch


def test_full_gossip_closed_form(spark, sf):
    from granary.plans import registry

    total, copies = registry.QUERIES["bytes_sent"](spark, sf).first()
    payload = registry.stream_items(spark, sf).agg(F.sum("payload"), F.count("*")).first()
    f = registry.FANOUT
    assert (total, copies) == ((f + f * f) * payload[0], (f + f * f) * payload[1])


def test_quotas_and_encoding(spark):
    df = spark.createDataFrame([(k, "a" if k < 5 else "b" if k < 8 else "c") for k in range(10)], "id long, c string")
    assert {r.c: r.quota for r in prep.quotas(df, "c", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    codes = prep.encoder(df.where("c <> 'b'").unionByName(df.limit(1).withColumn("c", F.lit(None).cast("string"))), "c")
    assert {r.id: r.c for r in prep.encode(df, "c", codes).collect()} == {k: 1 if k < 5 else -1 if k < 8 else 2 for k in range(10)}
    assert prep.with_global_id(df).columns == ["__id", "c"] and prep.with_global_id(df.drop("id")).select("__id").distinct().count() == 10


def test_scores_by_hand(spark):
    pred = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)], "label int, predicted int")
    macro, balanced = evaluate.accuracy_scores(pred).first()
    assert macro == pytest.approx((0.5 + 0.8 + 0) / 3, abs=1e-6) and balanced == pytest.approx((0.5 + 1 + 0) / 3, abs=1e-6)
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    ap, auc = evaluate.ranking_scores(scored).first()
    assert ap == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-6) and auc == pytest.approx(3.5 / 4)


def test_delimited_scan(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("﻿a;b;c\n1;\"2;3\n\n4;;\n".encode())
    rows = [tuple(r) for r in tables.scan_delimited(spark, str(path), ";,").collect()]
    assert rows == [("1", '"2', "3"), ("", None, None), ("4", "", "")]
    path.write_text('a,b\n1,"x,""y"""\n')
    assert [tuple(r) for r in tables.scan_delimited(spark, str(path), quoted=True).collect()] == [("1", 'x,"y"')]


def test_sinks_round_trip(spark, tmp_path):
    kept = spark.createDataFrame([(0, 1, 'x,"y"'), (1, 2, None)], "node int, __id long, t string")
    tables.write_retained(kept, str(tmp_path / "kept"))
    assert {(r.node, r["__id"], r.t) for r in tables.read_retained(spark, str(tmp_path / "kept")).collect()} == {(0, "1", 'x,"y"'), (1, "2", None)}
    for mode, ratio in (("baseline", 1.0), ("random", 0.1)):
        tables.write_metrics(spark, str(tmp_path / "m" / mode), "d", mode, ratio, 8, 5)
    assert [(r.mode, r.keepRatio) for r in tables.read_metrics(spark, str(tmp_path / "m")).collect()] == [("baseline", None), ("random", 0.1)]
    assert tables.output_path("o", "d", "random", 0.125) == "o/d/random/13" and tables.output_path("o", "d", "baseline", 1.0) == "o/d/baseline"
    keys = spark.createDataFrame([("x/CreditCard_train.csv",), ("forestType.csv",), ("a_train.CSV",)], "p string").select(tables.dataset_key(F.col("p")).alias("k"))
    assert [r.k for r in keys.collect()] == ["credit_card", "forest_type", "a"]


def test_a_new_representative_has_an_empty_bin():
    state = stateful.UtilityNode(10, 2)
    state.offer(0, np.array([0.0], np.float32))
    assert state.bins == {0: stateful.Bin(0, 0.0)}
    state.offer(1, np.array([4.0], np.float32))
    # the first item near a bin that holds nothing is scored against the least mean distance
    assert state.offer(2, np.array([0.5], np.float32)).utility > 1e8
    assert state.others[2].near == 0 and state.bins[0].load == 1


def test_earlier_representatives_win_ties_and_unsound_vectors_are_dropped():
    state = stateful.UtilityNode(20, 3)
    for key, x in enumerate((0.0, 2.0, 50.0)):
        state.offer(key, np.array([x], np.float32))
    state.offer(3, np.array([1.0], np.float32))
    assert state.others[3].near == 0
    assert state.offer(4, np.array([np.nan], np.float32)).kind == "DROPPED"
    assert stateful.UtilityNode(0, 1).offer(1, np.array([1.0], np.float32)).kind == "DROPPED"
    assert stateful.ReservoirNode(0, 1).offer(1).kind == "DROPPED"


def test_bins_hold_what_is_nearest():
    state, vectors_of = stateful.UtilityNode(40, 6), make(400, 3, 5)
    for key, v in enumerate(vectors_of):
        state.offer(key, v)
        for item in state.others.values():
            d = stateful.distances(item.vector, [r.vector for r in state.reps.values()])
            assert item.distance == pytest.approx(d.min()) and list(state.reps)[int(d.argmin())] == item.near
    assert state.snapshot()[0] == 40


def test_stored_counts_admissions_and_evictions(spark):
    rows = [(0, 1, "ADMITTED", None), (0, 2, "EVICTED_AND_ADMITTED", 1), (0, 1, "EVICTED_AND_ADMITTED", 2), (0, 3, "DROPPED", None), (1, 2, "ADMITTED", None)]
    events = spark.createDataFrame(rows, "node int, key long, kind string, evicted_key long")
    assert {tuple(r) for r in stateful.stored(events).collect()} == {(0, 1), (1, 2)}


def test_rounds_of_gossip(spark):
    items = spark.createDataFrame([(k % 4, k, k, v.tolist(), 30) for k, v in enumerate(make(80, 3))], "node int, seq long, key long, vector array<float>, payload long")
    events, sent = rounds.simulate(items, "random", 80, 1, 4, 3, F.floor(F.col("seq") / 40), 2, 2)
    # with room for all and all peers drawn, every node ends with every row; each copy goes to three peers
    assert {tuple(r) for r in stateful.stored(events).groupBy("node").count().collect()} == {(n, 80) for n in range(4)}
    assert sent.count() % 3 == 0 and sent.where("src = dst").count() == 0
    counts = rounds.counters(events).agg(F.sum("seen"), F.sum("own"), F.sum("admitted"), F.sum("dropped_duplicate"), F.sum("evicted")).first()
    assert counts[0] == 80 + sent.count() and counts[1] == 80 and counts[2] == 320 and counts[0] - counts[3] == 320 and counts[4] == 0
    tight, _ = rounds.simulate(items, "utility", 6, 2, 4, 2, F.floor(F.col("seq") / 40), 2, 2)
    assert {r["count"] for r in stateful.stored(tight).groupBy("node").count().collect()} == {6}
    alone, none = rounds.simulate(items.withColumn("node", F.lit(0)), "utility", 6, 2, 1, 1, F.floor(F.col("seq") / 40), 2, 2)
    assert stateful.stored(alone).count() == 6 and none.count() == 0


def test_windows_of_offers(spark):
    items = spark.createDataFrame([(0, k, k, v.tolist()) for k, v in enumerate(make(25, 3))], "node int, seq long, key long, vector array<float>")
    got = stateful.window_reports(stateful.retain_in_order(items, "utility", 8, 3, 1, every=10), 10).orderBy("window_no").collect()
    assert [r.seen for r in got] == [10, 10, 5] and [r.stored for r in got] == [8, 8, None] and all(r.admitted + r.dropped == r.seen for r in got)


@pytest.mark.parametrize("mode,order", [("baseline", "sequential"), ("random", "sequential"), ("utility", "sequential"), ("random", "free"), ("utility", "free")])
def test_whole_run(spark, tmp_path, mode, order):
    lines = ["id,x,y,label"] + [f"{k},{v[0]},{v[1]},{k % 3}" for k, v in enumerate(make(200, 2))]
    (tmp_path / "Some_train.csv").write_text("\n".join(lines) + "\n")
    cfg = config.RetentionConfig(path=str(tmp_path / "Some_train.csv"), mode=mode, nodes=4, ratios=(0.05, 0.1), ignore=("label",), id_column="id", rounds=2, order=order)
    totals = sweep.run(spark, cfg, str(tmp_path / "out")).collect()
    assert len(totals) == (4 if mode == "baseline" else 8) and all(r.admitted + r.dropped == r.seen for r in totals)
    if mode == "baseline":
        assert {r.stored for r in totals} == {200} and sum(r.bytes_sent for r in totals) > 0
        kept = tables.read_retained(spark, str(tmp_path / "out/some/baseline/retained"))
    else:
        assert {(r.ratio, r.stored) for r in totals} == {(0.05, 10), (0.1, 20)}
        assert tables.available_ratios(spark, str(tmp_path / f"out/some/{mode}")) == [0.05, 0.1]
        kept = tables.read_retained(spark, str(tmp_path / f"out/some/{mode}/10/retained"))
    assert kept.columns == ["__id", "id", "x", "y", "label", "node"] and kept.where("__id <> id").count() == 0
    assert tables.read_metrics(spark, str(tmp_path / "out")).count() == (1 if mode == "baseline" else 2)
    assert kept.groupBy("node", "__id").count().where("count > 1").count() == 0


def test_run_refuses_bad_settings(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,2\n1,3\n2,4\n")
    with pytest.raises(ValueError, match="unique"):
        sweep.run(spark, config.RetentionConfig(path=str(tmp_path / "a.csv"), ratios=(0.9,), id_column="id", nodes=2), str(tmp_path / "o"))
    with pytest.raises(ValueError, match="share"):
        sweep.run(spark, config.RetentionConfig(path=str(tmp_path / "a.csv"), ratios=(0.101, 0.102)), str(tmp_path / "o"))


def test_rows_equal_to_the_header_stay(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b\n1,2\na,b\n")
    assert [tuple(r) for r in tables.scan_delimited(spark, str(tmp_path / "h.csv")).collect()] == [("1", "2"), ("a", "b")]


def test_samples_and_columns(spark):
    df = spark.createDataFrame([(k, int(k < 6), float(k)) for k in range(30)], "id long, y int, x double")
    assert prep.sample(df, "id", "y", 10, "binary", 0.3).groupBy().agg(F.sum("y"), F.count("*")).first() == (3, 10)
    assert prep.sample(df, "id", "y", 10, "multiclass").count() == 10 and prep.sample(df, "id", None, 7, "regression").count() == 7
    with pytest.raises(ValueError, match="class 1"):
        prep.sample(df, "id", "y", 10, "binary", 0.9)
    assert prep.reindexed(df, ["x", "z"]).columns == ["x", "z"]
    assert prep.numeric_only(df.withColumn("t", F.lit("a")).withColumn("x", F.lit(float("inf")))).first() == (0.0, 1.0, 0.0)


def test_first_rows_equal_a_sort(spark):
    rows = [(k % 3, k, float(u)) for k, u in enumerate(np.random.default_rng(3).integers(0, 40, 300) / 7)]
    df = spark.createDataFrame(rows, "node int, key long, utility double")
    ordered = {n: sorted((r for r in rows if r[0] == n), key=lambda r: (-r[2], r[1])) for n in range(3)}
    for room in (0, 1, 17, 100, 500):
        best = {(r.node, r.key): r["rank"] for r in vectors.keep_best(df, room).collect()}
        assert best == {(n, r[1]): i for n in range(3) for i, r in enumerate(ordered[n][:room], 1)}
        bucket = retention.utility_bucket(F.col("utility"))
        assert {tuple(r) for r in retention.first_rows(df, "node", bucket, room, F.desc("utility"), "key").collect()} == {r for n in range(3) for r in ordered[n][:room]}
    wanted = spark.createDataFrame([(0, 5), (2, 200)], "node int, quota long")
    got = retention.first_rows(df, "node", retention.utility_bucket(F.col("utility")), wanted, F.desc("utility"), "key", bounded=False)
    assert {tuple(r) for r in got.collect()} == {*ordered[0][:5], *ordered[2]}
    assert vectors.keep_best(df.limit(0), 5).count() == 0 and prep.uniform_rows(df, "key", 400).count() == 300
    huge = spark.createDataFrame([(0, 1, 1e300), (0, 2, 1e9), (0, 3, 0.0)], "node int, key long, utility double")
    assert [r.key for r in vectors.keep_best(huge, 2).orderBy("rank").collect()] == [1, 2]


def test_small_sides_are_broadcast_and_large_ones_not(spark):
    items = spark.createDataFrame([(k, 0, [float(k)]) for k in range(5)], "key long, node int, vector array<float>")
    reps = vectors.representatives(items, 2)
    plan = lambda size: vectors.two_nearest(items, reps, size)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(vectors.bytes_of(1, 2, 1)) and "broadcast" not in plan(None) and "broadcast" not in plan(vectors.SMALL + 1)


def test_forest_per_node_has_the_trees_of_the_operator(spark, sf, monkeypatch):
    from granary.plans import registry

    asked = []
    monkeypatch.setattr(registry.evaluate, "trained_scores", lambda kept, test, nodes, model="forest", trees=300: asked.append((model, trees)))
    registry.QUERIES["forest_per_node"](spark, sf)
    assert asked == [("forest", 300)]


@pytest.mark.parametrize("seed", range(40))
def test_state_machine_equals_its_plain_restatement(seed):
    from tests.plain_node import PlainNode

    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(2, 60))
    reps = int(rng.integers(1, max(2, capacity)))
    grid = rng.integers(0, 4, (400, 2)).astype(np.float32) if seed % 2 else rng.normal(size=(400, 3)).astype(np.float32)  # a grid has many ties
    grid[rng.random(400) < 0.02] = np.nan
    ours, plain = stateful.UtilityNode(capacity, reps, gamma=float(rng.uniform(0, 2))), None
    plain = PlainNode(capacity, reps, ours.gamma)
    for key, v in enumerate(grid):
        d = ours.offer(key, v)
        assert (d.kind, d.evicted) == plain.offer(key, v), (seed, key)
    assert set(ours.reps) == {r[0] for r in plain.reps} and set(ours.others) == set(plain.items)


def test_an_offer_costs_the_same_at_a_large_budget():
    import time

    def seconds(capacity):
        node = stateful.UtilityNode(capacity, 16)
        rng = np.random.default_rng(0)
        for key in range(capacity):
            node.offer(key, rng.normal(size=4).astype(np.float32))
        changes, began = 0, time.perf_counter()
        for key in range(capacity, capacity + 1500):
            changes += node.offer(key, rng.normal(size=4).astype(np.float32)).rep_change
        return (time.perf_counter() - began) / 1500, changes

    small, large = seconds(500), seconds(8000)
    assert large[1] > 20 or large[0] < 6 * small[0]


def test_time_split_by_hand(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([5, 1, 9, 9, 9, 2, None])], "key long, t int")
    train, test = prep.split_with_drift(df.where("t IS NOT NULL"), "t", "key", 2)
    assert {r.key for r in test.collect()} == {3, 4} and {r.key for r in train.collect()} == {0, 1, 2, 5}
    with pytest.raises(ValueError):
        prep.split_with_drift(df, "t", "key", 7)
    with pytest.raises(ValueError):
        prep.sample(df, "key", None, 8, "regression")
    assert [r["__id"] for r in prep.with_global_id(df.select("t").repartition(3)).orderBy("__id").collect()] == list(range(7))


def test_a_cluster_without_a_shared_folder_is_refused():
    from granary.sources import tables

    class Spark:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        tables.work_path(Spark, "x")
