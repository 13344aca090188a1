"""The row-by-row fleet against a plain loop, and its rules for queues and views."""

import numpy as np
import pytest

from granary import config
from granary.operators import fleet
from granary.operators.stateful import new_state
from granary.plans import sweep


class Still(fleet.Overlay):
    """Views that never change, drawn in order: what remains is the fleet's own logic."""

    def draw(self, i, most):
        return [p for p in range(self.nodes) if p != i][:most]

    def cycle(self):
        pass


def by_hand(rows, how, mode, room, reps):
    """A plain loop over rows: (counts per node, stored keys per node)."""
    states = [new_state(mode, i, room, reps) for i in range(how.nodes)]
    queues, counts, held = [[] for _ in states], [[0, 0, 0, 0, 0] for _ in states], [set() for _ in states]

    def offer(i, key, v, payload, left):
        counts[i][0] += 1
        if key in held[i]:
            counts[i][2] += 1
            return
        d = states[i].offer(key, v)
        if d.kind == "DROPPED":
            counts[i][2] += 1
            return
        counts[i][1] += 1
        held[i].add(key)
        if d.evicted is not None:
            counts[i][3] += 1
            held[i].discard(d.evicted)
        if left > 0:
            queues[i].append((key, v, payload, left))
            if len(queues[i]) > how.queue:
                queues[i].pop(0)

    def step():
        for i in range(how.nodes):
            batch, queues[i] = queues[i][: how.batch], queues[i][how.batch :]
            for p in [p for p in range(how.nodes) if p != i][: how.fanout]:
                for key, v, payload, left in batch:
                    counts[i][4] += payload
                    offer(p, key, v, payload, left - 1)

    for n, (node, key, v, payload) in enumerate(rows, 1):
        offer(node, key, v, payload, how.ttl)
        if n % how.cycle == 0:
            step()
    while any(queues):
        step()
    return counts, held


@pytest.mark.parametrize("mode", ["random", "utility"])
@pytest.mark.parametrize("queue", [5, 1000])
def test_fleet_equals_a_plain_loop(monkeypatch, mode, queue):
    monkeypatch.setattr(fleet, "Overlay", Still)
    rng = np.random.default_rng(4)
    rows = [(k % 5, 3 * k, rng.normal(size=4).astype(np.float32), 30 + k % 7) for k in range(400)]
    how = fleet.Fleet(5, 2, 4, 4, cycle=7, batch=3, queue=queue, every=90)
    members = [fleet.Member(new_state(mode, i, 25, 5), queue) for i in range(5)]
    frames = list(how.play(0, iter(rows), members))
    counts, held = by_hand(rows, how, mode, 25, 5)
    assert [[m.counts[c] for c in ("seen", "admitted", "dropped", "evicted", "bytes_sent")] for m in members] == counts
    assert [m.keys for m in members] == held
    assert (queue == 5) == any(m.lost for m in members)
    told = [f for f in frames if (f["kind"] == "REPORT").all()]
    assert [f["n_rows"].iloc[0] for f in told] == [90, 180, 270, 360] and all((f["queue"] <= queue).all() for f in told)


def test_views_stay_bounded_without_oneself_and_change():
    overlay = fleet.Overlay(12, 4, 4, np.random.default_rng(1))
    before = np.isfinite(overlay.ages)
    for _ in range(20):
        overlay.cycle()
        known = np.isfinite(overlay.ages)
        assert (known.sum(axis=1) <= 4).all() and known.any(axis=1).all() and not known.diagonal().any()
    assert (known != before).any()


def test_merge_keeps_younger_ages_and_older_members():
    overlay = fleet.Overlay(6, 2, 2, np.random.default_rng(1))
    inf = np.inf
    overlay.ages[0] = [inf, 5, 3, inf, inf, inf]
    overlay.merge(0, np.array([0, 1, inf, 4, 2, inf]))
    assert overlay.ages[0].tolist() == [inf, inf, 3, 4, inf, inf]


def test_runs_are_apart_and_odd_rows_pass(spark):
    rows = [(k % 3, k, k, None if k == 7 else [float(k), 1.0], 30) for k in range(90)]
    items = spark.createDataFrame(rows, "node int, seq long, key long, vector array<float>, payload long")
    how, runs = fleet.Fleet(3, 2, 2, 2, every=30), [("random", 10, 1), ("utility", 20, 4), ("random", 10, 1)]
    events = fleet.simulate(items, runs, how).cache()
    last = fleet.finals(events).collect()
    assert len(last) == 9 and all(r.admitted + r.dropped == r.seen and r.queue == 0 for r in last)
    assert {(r.run, r.stored) for r in last} == {(0, 10), (1, 20), (2, 10)}
    kept = {(r.run, r.node): r["count"] for r in fleet.stored(events).groupBy("run", "node").count().collect()}
    assert kept == {(r.run, r.node): r.stored for r in last}
    assert fleet.stored(events).where("key = 7").count() == 0
    assert [(r.run, r.n_rows) for r in fleet.progress(events).orderBy("run", "n_rows").collect()] == [(r, n) for r in range(3) for n in (30, 60, 90)]
    assert fleet.simulate(items.limit(0), runs, how).count() == 0
    with pytest.raises(ValueError):
        fleet.simulate(items, [("baseline", 1, 1)], how)


@pytest.mark.parametrize("mode", ["random", "utility"])
def test_whole_run_with_gossip_between_rows(spark, tmp_path, mode):
    rng = np.random.default_rng(2)
    (tmp_path / "Some_train.csv").write_text("\n".join(["id,x,y"] + [f"{k},{a},{b}" for k, (a, b) in enumerate(rng.normal(size=(200, 2)))]) + "\n")
    cfg = config.RetentionConfig(path=str(tmp_path / "Some_train.csv"), mode=mode, nodes=4, ratios=(0.05, 0.1), id_column="id", order="interleaved", cycle=20, report_every=50)
    totals = sweep.run(spark, cfg, str(tmp_path / "out")).collect()
    assert {(r.ratio, r.stored) for r in totals} == {(0.05, 10), (0.1, 20)} and all(r.admitted + r.dropped == r.seen and r.bytes_sent > 0 for r in totals)
    reports = spark.read.json(str(tmp_path / f"out/some/{mode}/10/reports"))
    assert sorted(r.n_rows for r in reports.select("n_rows").distinct().collect()) == [50, 100, 150, 200] and reports.count() == 16


def test_settings_of_gossip_are_checked():
    for wrong in ({"view": 0}, {"shuffle": 0}, {"swap": 0}, {"cycle": 0}, {"batch": 0}, {"queue": 0}, {"order": "interleaved", "mode": "baseline"}):
        with pytest.raises(ValueError):
            config.RetentionConfig(**wrong)
