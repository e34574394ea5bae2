"""Null ids, clashing columns, repeated rows and empty tables, for operators and pipeline stages."""

from __future__ import annotations

import collections
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_corpus import AWKWARD, ITEM, documents, toxic_data

from mosaicell.llm import common, decontam, line_dedup, media, mixing, ngram_join, sharding, toxicity

DATA = Path("/root/testdata/sf0.001")
#: Names that operators use or once used for columns of their own.
CLASHES = ["_gone", "_id", "_leak", "_item", "score", "size", "target", "taken", "copies", "source_size", "near_copy", "leaking_doc", "toxicity_score", "mix_src", "mix_hash", "mix_copies", "line_drops", "line_owner", "shuffle_bucket", "shuffle_rank", "component_id", "n"]


def clashing(df):
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHES})


def kept_whole(before, after):
    """after's rows are rows of before, in all columns of before."""
    assert after.columns[: len(before.columns)] == before.columns
    rows = {repr(tuple(r)) for r in before.collect()}
    got = [repr(tuple(r)) for r in after.select(before.columns).collect()]
    assert set(got) <= rows
    return got


def test_line_index_of_a_null_id_is_reversible(spark):
    line = "this line is long enough to be a key of the line index, surely"
    some = spark.createDataFrame([(None, line)] + [(i, line) for i in range(4)], "doc_id long, text string")
    index = line_dedup.LineIndex.build(some)
    refs = lambda x: sorted(map(tuple, x.refs.select("refs", "keeper").collect()))
    assert refs(index) == [(5, 3)]
    none = some.filter("doc_id IS NULL")
    assert refs(index.insert(none)) == [(5, 3)] and refs(index.insert(some)) == [(5, 3)]
    less = index.delete(none.select("doc_id"))
    assert refs(less) == [(4, 3)] and refs(less.insert(none)) == [(5, 3)]
    dropped = {r.doc_id: r.n_dropped for r in index.clean(some).collect()}
    assert dropped == {None: 1, 0: 1, 1: 1, 2: 1, 3: 0}


def test_operators_keep_clashing_columns(spark):
    docs = clashing(documents(spark, ["one two three four five six seven", "One two three four five six  seven", ITEM, "x", None]))
    bench = spark.createDataFrame([(1, ITEM, "x")], "item_id long, text string, doc_id string")
    assert len(kept_whole(docs, ngram_join.keep_first(docs))) == 4
    assert len(kept_whole(docs, decontam.keep_clean(docs, bench))) == 4
    assert len(kept_whole(docs.drop("text"), line_dedup.LineIndex.build(docs).clean(docs).drop("text"))) == 5
    assert len(kept_whole(docs, sharding.external_shuffle(docs))) == 5
    got = collections.Counter(kept_whole(docs, mixing.resample(docs)))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    assert sum(got.values()) == sum(copies.values()) and max(got.values()) <= 2


def test_toxicity_keeps_columns_and_repeated_rows(spark):
    docs, labels = toxic_data(spark, 300)
    wide = clashing(docs)
    twice = wide.unionByName(wide)
    kept = toxicity.keep_clean(twice, labels)
    got = collections.Counter(kept_whole(twice, kept))
    assert set(got.values()) == {2} and len(got) < 300
    model = toxicity.learn(docs, labels)
    assert {r["score"] for r in toxicity.score(wide, model).select("score").collect()} == {r["score"] for r in toxicity.score(docs, model).collect()}


def test_toxicity_samples_texts_that_fit(spark, monkeypatch):
    """The bound on rows holds for texts within the bound on bytes; others take no place in the sample."""
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 20)
    docs = spark.createDataFrame([(i, "kurz" if i % 2 else "lang " * 50) for i in range(400)] + [(None, "kurz")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(400)], "doc_id long, t boolean").select("doc_id", F.col("t").cast("int").alias("toxic"))
    texts, y, _ = toxicity.training_rows(docs, labels, {1: 30, 0: 40})
    assert set(texts) == {"kurz"} and collections.Counter(y.tolist()) == {1: 30, 0: 40}


def test_leaks_of_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, ITEM), (None, "clean"), (1, ITEM), (1, ITEM), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, ITEM), (7, ITEM), (None, ITEM)], "item_id long, text string")
    rows = [tuple(r)[:2] for r in decontam.find_leaks(docs, bench).collect()]
    assert sorted(rows, key=repr) == sorted([(None, 7), (None, None), (1, 7), (1, None)], key=repr)
    assert [tuple(r) for r in decontam.keep_clean(docs, bench).collect()] == [(2, "clean")]


def test_mixing_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b", "s"), (None, "a b c", "s"), (3, "x", None)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 3 and len({r.copies for r in rows if r.doc_id is None}) == 1
    assert mixing.resample(docs).count() == sum(r.copies for r in rows) and mixing.resample(docs.limit(0)).count() == 0
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    assert {(r.size, r.taken) for r in mixing.mix(sized, words="words").collect()} == {(r.size, r.taken) for r in rows}


def test_media_of_clashing_columns(spark):
    data = spark.createDataFrame([(1, bytearray(b"zz"), 5, "x"), (2, bytearray(b"zz"), 6, "y")], "id long, media binary, class_id int, digest string")
    assert {(r.id, r.class_id, r.class_size) for r in media.copies(data).collect()} == {(1, 1, 2), (2, 1, 2)}
    assert media.draw(None) is None and media.draw([]) is None and media.draw([1.0, None]) is None and media.draw([float("nan")]) is None
    assert media.draw([0.0] * 4) == media.draw([0.0] * 4) and media.draw([1e300, 1.0]) is not None


def test_slices_hold_to_their_bound():
    import pyarrow as pa

    texts = pa.array(["a" * n for n in (5, 0, 500, 3000, 1, 1, 1)] + [None])
    runs = list(common.slices(texts, 700))
    assert [k for a, n in runs for k in range(a, a + n)] == list(range(8)) and all(n == 1 or sum(len(t or "") + 64 for t in texts.slice(a, n).to_pylist()) <= 700 for a, n in runs)
    assert list(common.slices(texts.slice(0, 0))) == [] and list(common.slices(texts.slice(3, 2).cast(pa.binary()), 10)) == [(0, 1), (1, 1)]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages_with_awkward_documents(spark):
    """Each stage alone: nulls in any column, repeated rows, awkward texts and clashing names; then nothing at all."""
    import corpus_pipeline

    docs = common.table(spark, str(DATA), "documents").limit(60)
    odd = spark.createDataFrame([(10**6 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, None, None, None, None), (None, "text without an id", "en", "s", 1)], docs.schema)
    docs = clashing(docs.unionByName(docs).unionByName(odd))
    rows = collections.Counter(repr(tuple(r)) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(DATA))
        assert out.columns == (docs.columns if name != "sharding" else [*docs.columns, "shard", "slot"])
        got = collections.Counter(kept_whole(docs, out))
        most = 2 if name == "mixing" else 1
        assert got and all(n <= most * rows[k] for k, n in got.items())
        if name == "sharding":
            assert got == rows
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
