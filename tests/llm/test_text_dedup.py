import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm import common, components, neardup, substring

from . import brute

SCHEMA = "doc_id long, text string, n_words int, first string, node string, text2 string"
TEXT = st.text(alphabet=st.sampled_from(list("aB \t\n\x0b\x0c\ré\x85\xa0")), max_size=30)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, "f", "n", "t") for d, t in rows], SCHEMA)


@settings(deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_on_bytes(texts):
    w = common.Words(pa.array(texts, pa.string()))
    got = [[x.decode() for x in w.text(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]
    flat = [x for t in got for x in t]
    hashes = w.hashes()
    assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(common, "SEGMENT", 64)
    common._powers.clear()
    words = [random.Random(k).choice(["a", "bb", "ccc" * 50, "d"]) for k in range(500)]
    w = common.Words(pa.array([" ".join(words), "a bb"]))
    h = w.hashes()
    common._powers.clear()
    assert len(set(zip(words + ["a", "bb"], h.tolist(), strict=True))) == 4


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


def near_rows(n, seed=0):
    """A large group of near copies at similarities around the threshold, exact copies, and odd texts."""
    rng = random.Random(seed)
    base = [f"w{rng.random()}" for _ in range(150)]
    rows = [(k + 10, " ".join(edited(base, rng.randrange(0, 9), rng))) for k in range(n)]
    rows += [(500 + k, rows[k][1].upper().lower()) for k in range(5)] + [(600, rows[0][1].replace(" ", "\n\t"))]
    rows += [(700, None), (701, ""), (702, " \n"), (703, "one"), (704, "One"), (705, "one two"), (706, "one two"), (707, "a b c"), (708, "A  b\tc"), (10, rows[0][1])]
    rows += [(800 + k, " ".join(f"z{rng.random()}" for _ in range(rng.randrange(1, 30)))) for k in range(20)]
    return rows + [(900, "x " * 60_000), (901, "x x x")]


@pytest.mark.parametrize("block,k,percent", [(1024, 3, 85), (4, 3, 85), (4, 5, 80)])
def test_components_against_brute_force(spark, monkeypatch, block, k, percent):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "REGISTER_BLOCK", block + 3)
    rows = near_rows(60)
    out = neardup.near_duplicates(frame(spark, rows), k, percent).collect()
    want = brute.near_components(rows, k, percent)
    assert len(out) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(d, *x) for d, x in want.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def noted(monkeypatch, module):
    """The names and physical plans of what ``module`` writes from now on."""
    plans, plain = [], common.written

    def spy(df, name, files=None):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return plain(df, name, files)

    monkeypatch.setattr(module, "written", spy)
    return plans


def test_no_plan_holds_another_one_several_times(spark, monkeypatch):
    plans = noted(monkeypatch, neardup)
    out = neardup.near_duplicates(frame(spark, near_rows(60)))
    plans.append(("result", out._jdf.queryExecution().sparkPlan().toString()))
    assert {"pairs", "links", "result"} <= {name for name, _ in plans}
    for name, plan in plans:
        assert plan.count("MapInArrow") <= 1 and plan.count("Join") <= 4, name


def test_stars_take_no_round(spark, monkeypatch):
    plans = noted(monkeypatch, components)
    links = [(1, k) for k in range(2, 9)] + [(20, 20), (11, 10), (10, 11)]
    out = components.components(spark.createDataFrame(links, "x long, y long")).collect()
    assert sorted((r.node, r.component) for r in out) == [(k, 1) for k in range(1, 9)] + [(10, 10), (11, 10)]
    assert len(plans) == 1
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0 and len(plans) == 2


@pytest.mark.parametrize("keep", ["inner", "left"])
@pytest.mark.parametrize("hot", [False, True])
def test_joins_with_and_without_hot_keys(spark, keep, hot):
    rows = [(k % 7 or None, k) for k in range(70)] + [(9, 100 + k) for k in range(common.HOT_ROWS + 1 if hot else 3)]
    left = spark.createDataFrame(rows, "key long, at long")
    keyed = left.where("key > 2").groupBy("key").count().selectExpr("key", "count as n", "key * 10 as value")
    total, most = common.loads_of(keyed, "n")
    of = {k for k, _ in rows if k and k > 2}
    assert total == sum(k in of for k, _ in rows) and (most > common.HOT_ROWS) == hot
    want = sorted((str(k), at, k * 10 if k in of else None) for k, at in rows if keep == "left" or k in of)
    for known in (None, most):
        met = common.joined_evenly(left, keyed, ["key"], "n", total, left["at"], keep, most=known)
        assert met.columns == ["key", "at", "value"] and sorted((str(r.key), r.at, r.value) for r in met.collect()) == want
        assert ("__hot" in met._jdf.queryExecution().optimizedPlan().toString()) == (known is None or hot)


def test_near_duplicates_without_ids_or_rows(spark):
    out = neardup.near_duplicates(frame(spark, [(None, "a b c d"), (1, "a b c d"), (2, "a b c d")])).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in out) == [(0, None, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_estimate_of_registers():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        found = []
        for _ in range(60):
            both, own = (np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (int(1000 * share), 1000 - int(1000 * share)))
            a, b = np.union1d(both, own[::2]), np.union1d(both, own[1::2])
            est, used = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))
            found.append(est[0])
        assert abs(np.mean(found) - share) < 0.03 and used[0] == neardup.BUCKETS


def test_star_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(300 + k, 301 + k) for k in range(40)] + [(400, k) for k in range(401, 430)]
    root = {}
    for x in {v for e in links for v in e if e[0] != e[1]}:
        root[x] = x
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    out = components.components(spark.createDataFrame(links, "x long, y long")).collect()
    assert sorted((r.node, r.component) for r in out) == sorted(root.items())


def repeat_rows(seed=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    shared = [[word() for _ in range(n)] for n in (12, 13, 14, 30, 60, 200)]
    rows = []
    for k in range(80):
        parts = [[word() for _ in range(rng.randrange(0, 40))]]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, max(1, len(s) - 12))
            parts += [s[a : a + rng.randrange(10, 90)], [word() for _ in range(rng.randrange(0, 9))]]
        rows.append((1000 - k * 7, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    line = "the same line of words again and again "
    return rows + [(3, line * 40), (4, line * 60 + "end"), (5, line * 2), (6, "x " * 30_000), (7, "x " * 14), (8, None), (9, ""), (20, rows[5][1]), (21, rows[5][1].replace(" ", "  "))]


def test_substring_dedup_against_brute_force(spark):
    rows = repeat_rows()
    rows = [*rows, (-5, rows[2][1] + " q"), (-(1 << 62), " ".join(brute.words(rows[3][1])[:40])), ((1 << 61) + 3, rows[4][1] + " z")]
    out = substring.deduplicated(frame(spark, [*rows, rows[0]])).collect()
    want = brute.without_repeats(rows, 13)
    assert len(out) == len(rows) + 1
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_words) == want[r.doc_id], r.doc_id
        assert sum(b - a for a, b in r.removed_spans) == r.n_removed
    assert sum(r.n_removed for r in out) > 500


def test_substring_dedup_without_ids_or_rows(spark):
    text = " ".join(map(str, range(40)))
    out = substring.deduplicated(frame(spark, [(None, text), (None, text), (5, text), (6, text + " x")]), window=20).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.first) for r in out) == [(0, 0, "f"), (0, 0, "f"), (5, 0, "f"), (6, 40, "f")]
    assert substring.deduplicated(frame(spark, [])).count() == 0


def test_queries_over_whole_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    repeats, near = brute.without_repeats(rows, 13), brute.near_components(rows, 3, 85)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op4_substring_dedup(spark, sf).collect()}
    assert got == {d: (n, m, hashlib.sha256(t.encode()).hexdigest()) for d, (n, m, t) in repeats.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.op7_near_duplicates(spark, sf).collect()} == near


def template_rows(n, part, seed=4):
    """Pages of one template, alike to each other, and a few pairs that are copies but for a word."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(200)]
    own = int(200 * (1 - part) / 2)
    rows = [(k, " ".join(base + [f"p{rng.random()}" for _ in range(own)])) for k in range(n)]
    return rows + [(n + k, rows[k * 7][1] + " more") for k in range(5)]


@pytest.mark.parametrize("part", [0.5, 0.75])
def test_templates_leave_by_their_own_shingles(spark, monkeypatch, part):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = template_rows(60, part)
    out = neardup.near_duplicates(frame(spark, rows), 5, 90).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == {(d, *x) for d, x in brute.near_components(rows, 5, 90).items()}


def test_linkable_is_exact(spark):
    rows = template_rows(40, 0.6) + [(200, "a b c d e f g h"), (201, "a b c d e f g h i")]
    df = frame(spark, rows).select("doc_id", "text")
    members = spark.createDataFrame([(k % 2, d, d) for d, _ in rows for k in (0, 1)], "key long, doc_id long, component long")
    left = {r.doc_id for r in neardup.linkable(members, df, 3, 85, 16).collect()}
    assert {0, 40, 7, 41, 200, 201} <= left and len(left) < 15  # pairs stay, lone pages go


def test_near_in_block_finds_what_estimates_allow():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64))
    sets = [base, np.union1d(base[10:], base[:5]), np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64)), base]
    registers = np.stack([neardup.registers(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    side = np.zeros(4, int)
    assert neardup.near_in_block(registers, sizes, np.array([0, 1, 2, 0]), side, 85).tolist() == [True, True, False, True]
    assert neardup.near_in_block(registers, sizes, np.array([0, 0, 2, 0]), side, 85).tolist() == [False] * 4
    assert neardup.near_in_block(registers, sizes, np.array([0, 1, 2, 3]), np.array([0, 0, 0, 1]), 85).tolist() == [True, True, False, True]
