import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from granary.llm import mixing, tokens, toxicity
from granary.llm.common import written

from . import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows before each stage, and what the last one returns."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, sf), f"test-{name}")
    return [*out, docs]


def test_columns_are_those_of_documents(stages):
    assert [c for c, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    for after in stages[1:-1]:
        assert after.dtypes == stages[0].dtypes


def test_toxic_documents_go(spark, sf, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.scored(stages[0], model).collect() if not r.toxic_verdict}
    assert {r.doc_id for r in stages[1].collect()} == kept and 0 < len(kept) < stages[0].count()


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {d for d, (_, c) in brute.near_components(rows, 5, 80).items() if d == c}
    assert {r.doc_id for r in stages[2].collect()} == want and len(want) < len(rows)


def test_one_of_repeated_rows_stays(spark, sf):
    long, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, long), (1, long), (1, long.upper()), (2, long), (3, other), (3, "two words"), (4, ""), (4, ""), (5, None), (5, None), (None, other), (None, other)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int"), sf).collect()
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in out)
    assert got == sorted([("1", long), ("3", other), ("3", "two words"), ("4", ""), ("5", ""), ("None", other), ("None", other)])


def test_repeated_passages_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, sf).collect()}
    for d, (n, gone, kept) in brute.without_repeats([(d, r.text) for d, r in rows.items()], corpus_pipeline.PASSAGE).items():
        if n and gone == n:
            assert d not in got
        else:
            assert got[d].text == (kept if gone else rows[d].text)
            assert got[d].n_chars == (len(kept) if gone else rows[d].n_chars)


def test_the_mix_takes_runs_of_words_up_to_each_target(stages):
    texts = {r.doc_id: (r.source, brute.words(r.text)) for r in stages[3].collect()}
    taken, sizes = defaultdict(int), defaultdict(int)
    for s, w in texts.values():
        sizes[s] += len(w)
    for r in stages[4].collect():
        words = brute.words(r.text)
        taken[r.source] += len(words)
        assert f" {' '.join(words)} " in f" {' '.join(texts[r.doc_id][1])} "
    targets = {r.source: r.target for r in mixing.mix(stages[3])[0].select("source", "target").distinct().collect()}
    assert {s: taken[s] for s in targets} == {s: int(t) for s, t in targets.items()}
    assert abs(sum(targets.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_packed_pieces_spell_the_mix(stages):
    want = sorted(zlib.crc32(np.append(tokens.ids(r.text or ""), 0).astype("<u4").tobytes()) for r in stages[4].collect())
    pieces = stages[5].collect()
    by_doc, length = defaultdict(list), defaultdict(int)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
        length[p.sequence_id] += p.length
    assert max(length.values()) <= 1024 and sum(p.length for p in pieces) == sum(len(p.ids) for p in pieces) // 4
    alone = [zlib.crc32(b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: p.start))) for own in by_doc.values() if sum(p.length for p in own) == own[0].doc_tokens]
    assert alone and set(alone) <= set(want)


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).select("doc_id", "start", "length").count() == stages[5].count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, a int, b int, src string, __content string, __passages string, row int, slot int, `q``uote.d` int, n_words int, n_removed int, score string, nth int, content long, id string"


def odd_rows():
    long = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [
        (1, long(1, 90)), (1, long(2, 60)), (2, long(1, 90)), (3, long(3, 50) + " " + long(1, 45)), (4, long(4, 30)), (4, long(4, 30)), (5, None), (6, ""), (7, " \n\t"),
        (None, long(1, 90)), (None, long(5, 40)), (8, long(8, 170_000)), (9, "you idiot " * 20 + long(9, 20)), (10, long(3, 50)),
    ]
    return [(d, t, "en" if k % 3 else None, ("s", "t", None)[k % 3], len(t or ""), 1, 2, "z", "c", "p", 3, 4, 5, 6, 7, "x", 8, 9, "i") for k, (d, t) in enumerate(texts)]


def labelled(spark, path):
    rows = [(k, 0, k % 2) for k in range(100, 300)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return [(k, ("you idiot " if k % 2 else "kind ") + f"word w{k}", "en", "l", 20, 1, 2, "z", "c", "p", 3, 4, 5, 6, 7, "x", 8, 9, "i") for k in range(100, 300)]


def test_every_stage_on_odd_rows(spark, tmp_path):
    labels = labelled(spark, tmp_path)
    first = spark.createDataFrame(odd_rows() + labels, ODD)
    docs = first
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.dtypes == first.dtypes, name
        told = docs.collect()
        assert all((r["a"], r["b"], r["__content"], r["q`uote.d"], r["n_words"], r["content"]) == (1, 2, "c", 5, 6, 9) for r in told), name
        ids = Counter(r.doc_id for r in told)
        assert ids[8] >= 1 and ids[None] >= 2, name  # very long, and without an id
        if name == "toxicity":
            assert ids[9] == 0 and ids[1] == 2 and ids[6] == ids[5] == ids[7] == 1 and ids[4] == 2
        if name == "near_duplicates":
            assert ids[2] == 0 and ids[1] == 2 and ids[4] == 1 and ids[10] == 1 and ids[5] == 1
        if name == "repeated_passages":
            kept = {r.doc_id: r.text for r in told}
            assert len(brute.words(kept[3])) == 50 and ids[10] == 0 and kept[5] is None and kept[6] == ""
        if name == "source_mix":
            assert ids[5] == ids[6] == ids[7] == 0
    pieces = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert sum(p.length for p in pieces) == sum(len(tokens.ids(r.text or "")) + 1 for r in docs.collect())


def test_every_stage_on_an_empty_table(spark, tmp_path):
    labelled(spark, tmp_path)
    empty = spark.createDataFrame([], ODD)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
