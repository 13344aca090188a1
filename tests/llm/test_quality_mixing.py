import duckdb
import pytest
from pyspark.sql import functions as F

from granary.llm import mixing, quality

from . import brute

SCHEMA = "doc_id long, text string, source string, lang string, host int, k int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, "en", 1, 2, "x") for d, t, s in rows], SCHEMA)


def repeat_words(text):
    w = brute.words(text)
    seen, marked = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked.update(p for i in at for p in (i, i + 1, i + 2))
    return len(marked)


TEXTS = ["", None, " \t\n", "a", "a b c a b c", "x " * 500, "one line\none line\n\n\t\nother", "# $ a|b & é", "a\x0bb\x0cc\rd", "w" * 200_000, " ".join(map(str, range(3000))), "a b c d a b x a b c"]


def test_base_counts_against_brute_force(spark):
    rows = [(k, t, "s") for k, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in quality.line_rules(frame(spark, rows)).collect()}
    for k, t, _ in rows:
        w = brute.words(t)
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat_words(t))
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_lines_by_join_null_ids_and_the_ceiling(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, f"Menu\n{body(k)}", "a") for k in range(15)] + [(-1, f"Menu\n{body(99)}", "a")] + [(None, f"Menu\n{body(0)}", "a")]
    df = spark.createDataFrame([(*r, "keep", 1, 2) for r in rows], "doc_id long, text string, source string, `__content` string, `gone` int, `q``d.e` int")
    for more in (1 << 18, 0):
        assert {r.line for r in quality.frequent_in(df, max_docs=15, broadcast_rows=more).select("line").collect()} and not quality.frequent_in(df, max_docs=16, broadcast_rows=more).count()
    out = quality.clean_lines(df, max_docs=15)
    assert out.columns == df.columns and {r["__content"] for r in out.collect()} == {"keep"} and {r.text for r in out.collect()} == {body(k) for k in (*range(15), 99)}
    assert quality.clean_lines(df, max_docs=15, max_share=2.0).where("text LIKE 'Menu%'").count() == len(rows)
    assert quality.clean_lines(df, max_docs=15, max_share=2.0, most_docs=10).where("text LIKE 'Menu%'").count() == 0


def test_frequent_lines_go_and_depleted_documents_fail(spark):
    body = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(k, f"Menu  {k % 10}\n{body(k)}", "a") for k in range(30)]  # the menu line is frequent, its digit is 0 once normalised
    rows += [(100 + k, "same " * 30 + "\n" + " ".join(f"q{i}" for i in range(25)), "a") for k in range(25)]
    rows += [(200, f"Menu 1\n{body(200)}", None), (201, f"Menu 1\n{body(201)}", "b")]
    rows += [rows[0]]
    df = frame(spark, rows)
    out = quality.line_rules(df, max_docs=20)
    assert out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].removed_lines == 1 and got[0].removed_words == 2 and got[0].kept
    assert not got[100].kept and got[100].removed_words == got[100].n_words
    assert got[200].removed_lines == got[201].removed_lines == 0
    texts = {r.doc_id: r.text for r in quality.clean_lines(df, max_docs=20).collect()}
    assert texts[0] == body(0) and texts[200].startswith("Menu") and texts[100] == ""
    assert quality.line_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("module,name", [(quality, "op1_quality_rules"), (mixing, "op5_source_mix")])
def test_query_equals_sql(spark, sf, module, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    theirs = con.sql(module.SQL).df()
    ours = getattr(module, name)(spark, sf).toPandas()[list(theirs.columns)]
    ours, theirs = (x.astype({c: "float64" for c in x if x[c].isna().any()}).fillna(-1).round(6) for x in (ours, theirs))
    assert sorted(map(tuple, ours.values.tolist())) == sorted(map(tuple, theirs.values.tolist()))


def check_mix(spark, rows, **more):
    docs, pieces = mixing.mix(frame(spark, rows), **more)
    out = docs.collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        taken.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(n == int(target) for n, target in taken.values())
    assert (pieces.agg(F.sum(F.col("last") - F.col("first"))).first()[0] or 0) == sum(r.taken for r in out)
    assert sorted(docs.collect()) == sorted(mixing.mix(frame(spark, rows), **more)[0].collect())
    return out


def test_mix_reaches_every_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    monkeypatch.setattr(mixing, "CHUNK", 8)
    rows = [(k, "w " * (k * 7 % 40), ("a", "b", None, "é", "a", "a")[k % 6]) for k in range(120)] + [(0, None, "z"), (1, "w w", "z"), (1, "w w", "z")]
    out = check_mix(spark, rows, block=16)
    total = sum(r.size for r in out)
    assert abs(sum({r.source: r.target for r in out}.values()) - 1.5 * total) < 1e-6
    order = {r.source: r.target for r in out}
    assert order["z"] == 8.0  # weight 1, but no more than twice its 4 words


def test_mix_of_nothing(spark):
    assert check_mix(spark, [(1, None, "a"), (2, "", None)]) and mixing.mix(frame(spark, []))[0].count() == 0


def test_every_prefix_of_the_schedule_is_near_the_targets(spark):
    rows = [(k, "w " * (k * 7 % 90), ("a", "b", "c", "d", "a", "a", "e")[k % 7]) for k in range(900)]
    docs, pieces = mixing.mix(frame(spark, rows), block=16)
    targets = {r.src: r.target for r in docs.select(mixing.named(F.col("source")).alias("src"), "target").distinct().collect()}
    total = sum(targets.values())
    by_slot = {}
    for r in pieces.groupBy("slot", "src").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect():
        assert r.slot not in by_slot  # one source to a slot
        by_slot[r.slot] = (r.src, r.n)
    taken, worst = dict.fromkeys(targets, 0), 0.0
    for slot in sorted(by_slot):
        src, n = by_slot[slot]
        taken[src] += n
        worst = max(worst, *(abs(taken[s] - sum(taken.values()) * targets[s] / total) for s in targets))
    assert worst < 16 * 5  # a few blocks, of over a thousand
    first = {r.doc_id: r.first_slot for r in docs.collect()}
    assert first == {r.doc_id: r.s for r in pieces.groupBy("doc_id").agg(F.min("slot").alias("s")).collect()} | {d: None for d, s in first.items() if s is None}


def test_the_points_decide(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = sorted(map(tuple, mixing.op5_source_mix(spark, sf).select("doc_id", "taken", "first_slot").collect()))
    monkeypatch.setattr(mixing, "PHI", 0.25)
    after = sorted(map(tuple, mixing.op5_source_mix(spark, sf).select("doc_id", "taken", "first_slot").collect()))
    assert len(before) == docs.count() and [x[:2] for x in before] == [x[:2] for x in after] and before != after


def test_mixed_texts_of_repeated_ids_and_rows(spark):
    long = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, long(1, 100), "s"), (1, long(2, 60), "s"), (2, long(3, 30), "t"), (2, long(3, 30), "t"), (None, long(4, 20), None), (None, long(5, 21), None), (3, None, "s"), (4, "", "u")]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, a string, b int, src int, `we``ird.name` int, slot int")
    told = mixing.mix(docs)[0].collect()
    out = mixing.mixed_texts(docs).collect()
    assert mixing.mixed_texts(docs).columns == docs.columns and mixing.mixed_texts(docs.limit(0)).count() == 0
    of = {(d, s): [] for d, _, s in rows}
    for r in out:
        of[r.doc_id, r.source].append(r.text)
        assert any(f" {r.text} " in f" {t} " for d, t, s in rows if (d, s) == (r.doc_id, r.source) and t)
    for d, s in of:
        assert sum(len(brute.words(t)) for t in of[d, s]) == sum(r.taken for r in told if (r.doc_id, r.source) == (d, s))
