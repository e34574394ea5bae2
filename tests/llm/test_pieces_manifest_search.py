"""SentencePiece ids, Merkle manifests and ranked search: against the library, plain versions and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus import AWKWARD, documents

from mosaicell.llm import common, lexical, merkle, pieces, registry

DATA = Path("/root/testdata/sf0.001")
MODEL = registry.tokenizer_path("piece_bpe_32k.model")
needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def pieces_table():
    return pieces.PieceTable(MODEL)


# ------------------------------------------------------------------ pieces


def test_ids_equal_the_library_on_random_texts(pieces_table):
    r = random.Random(3)
    parts = ["▁", " ", "  ", "a", "the", "ing", "é", "ß", "1", "22", "\n", "\t", "中文", "x", "Z", "<s>", "<0x41>", "\0", "　", "🙂", "é", "ﬁ", "--", "....", "="]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        ids = pieces_table.encode(text)
        assert ids.tolist() == pieces_table.model.encode(text)
        assert pieces_table.decode(ids) == pieces_table.model.decode(ids.tolist())


def test_neighbours_alone_decide(pieces_table):
    """A row of tokens is an encoding if and only if each pair of neighbours is one."""
    r = random.Random(4)
    known = sorted(p for p in pieces_table.ids if len(p) <= 3)
    for _ in range(2000):
        row = [r.choice(known) for _ in range(3)]
        whole = pieces_table.merged("".join(row)) == row
        assert whole == (pieces_table.compatible("", row[0]) and all(map(pieces_table.compatible, row, row[1:])))


def test_long_texts_run_by_run(pieces_table, monkeypatch):
    texts = ["a" * 5000, " " * 5001, "=-" * 3000, "word " * 5000, "ab中\n🙂" * 3000, "\n" * 4000]
    monkeypatch.setattr(pieces, "RUN", 1000)
    monkeypatch.setattr(pieces, "MEMO_WORDS", 50)
    for text in texts:
        ids = pieces_table.encode(text)
        assert ids.tolist() == pieces_table.model.encode(text) and pieces_table.decode(ids) == pieces_table.model.decode(ids.tolist())
    assert all(len(w) <= pieces.MEMO_CHARS for w in pieces_table.words)


def test_encode_and_decode_tables(spark, pieces_table):
    docs = documents(spark, [*AWKWARD, "one text", "one text"]).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    once = pieces.encode(docs, MODEL, decoded=True)
    twice = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert once.columns == [c for c in docs.columns if c not in ("ids", "decoded")] + ["ids", "decoded"]
    rows = once.collect()
    assert len(rows) == docs.count() and Counter(map(repr, rows)) == Counter(map(repr, twice.collect()))
    for row in rows:
        ids = pieces_table.model.encode(row.text or "")
        assert row.ids == ids and row.decoded == pieces_table.model.decode(ids)
    digests = {r.doc_id: r for r in pieces.digest(once).collect()}
    for row in rows:
        assert digests[row.doc_id].n_tokens == len(row.ids)
        assert digests[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()
        assert digests[row.doc_id].decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()
    assert pieces.encode(docs.limit(0), MODEL, decoded=True).count() == 0
    assert pieces.decode(spark.createDataFrame([(None,)], "ids array<int>"), MODEL).first().decoded is None


@needs_tables
def test_sentencepiece_query_equals_the_library(spark, pieces_table):
    got = {r.doc_id: tuple(r)[1:] for r in registry.op11_sentencepiece(spark, str(DATA)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = common.table(spark, str(DATA), "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        ids = pieces_table.model.encode(row.text or "")
        assert got[row.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(pieces_table.model.decode(ids)))


# ------------------------------------------------------------------ manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, fanout):
    """The root, and of each node the siblings up to it."""
    proofs, owners, level = [[] for _ in nodes], [[k] for k in range(len(nodes))], list(nodes)
    while len(level) > 1:
        runs = [range(a, min(a + fanout, len(level))) for a in range(0, len(level), fanout)]
        for run in runs:
            for own in run:
                for leaf in owners[own]:
                    proofs[leaf] += [level[k] for k in run if k != own]
        owners = [[leaf for k in run for leaf in owners[k]] for run in runs]
        level = [sha(*(level[k] for k in run)) for run in runs]
    return level[0], ["".join(p) for p in proofs]


@pytest.mark.parametrize("fanout,block", [(2, 1024), (2, 4), (3, 9), (5, 5)])
def test_proofs_equal_a_plain_tree(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    r = random.Random(fanout * block)
    sizes = {None: 1, "": 2, "a": 7, "b": 53, "é": 19, "z": 1}
    rows = [(g, k, sha(str(g), str(k))) for g, n in sizes.items() for k in range(n)]
    r.shuffle(rows)
    # a clash, and a column that only passes through
    df = spark.createDataFrame([(*x, "old", k) for k, x in enumerate(rows)], "lang string, doc_id long, leaf string, root string, extra long")
    got = {(x.lang, x.doc_id): x for x in merkle.verify(merkle.prove(df, fanout=fanout), fanout=fanout).collect()}
    assert len(got) == len(rows)
    groups = sorted(sizes, key=lambda g: b"" if g is None else b"=" + g.encode())
    trees = {g: plain_tree([sha(str(g), str(k)) for k in range(sizes[g])], fanout) for g in groups}
    root, tops = plain_tree([trees[g][0] for g in groups], fanout)
    for at, g in enumerate(groups):
        for k in range(sizes[g]):
            x = got[g, k]
            assert (x.place, x.places, x.group_place, x.groups) == (k, sizes[g], at, len(groups))
            assert (x.subroot, x.root, x.folded_root, x.verified) == (trees[g][0], root, root, True)
            assert x.siblings == trees[g][1][k] + tops[at] and rows[x.extra] == (g, k, x.leaf)


def test_fold_rejects_other_leaves_places_and_lengths():
    nodes = [sha(str(k)) for k in range(11)]
    for fanout in (2, 4):
        root, proofs = plain_tree(nodes, fanout)
        for k, proof in enumerate(proofs):
            assert merkle.fold_proof(nodes[k], k, 11, 0, 1, proof, fanout) == root
            assert merkle.fold_proof(sha("x"), k, 11, 0, 1, proof, fanout) != root
            assert merkle.fold_proof(nodes[k], (k + 1) % 10, 11, 0, 1, proof, fanout) != root
            assert merkle.fold_proof(nodes[k], k, 11, 0, 1, proof + nodes[0], fanout) is None
            assert merkle.fold_proof(nodes[k], k, 11, 0, 1, proof[:-64], fanout) is None


def test_leaf_of_awkward_fields(spark):
    texts = [None, "", "é:-", "x" * 100_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    form = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    for row in df.withColumn("leaf", merkle.leaf([F.col("doc_id"), F.col("text")])).collect():
        assert row.leaf == sha(form(row.doc_id), form(row.text))


def test_manifest_of_ties_nulls_and_nothing(spark):
    one = ("s", None, 3, "text")
    rows = [(1, *one)] * 5 + [(None, *one)] * 3 + [(2, None, "en", None, None), (7, "s", "en", 2**31 - 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").withColumn("grp", F.lit(1)).withColumn("place", F.lit("x"))
    got = merkle.digest(docs).collect()
    assert len(got) == 10 and len({r.root for r in got}) == 1 and len({r.leaf for r in got if r.doc_id == 1}) == 1
    import zlib

    for r in got:
        shown = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.doc_id != 2
        assert r.verified is not shown and (r.folded_root == r.root) is not shown
    places = merkle.prove(merkle.document_leaves(docs)).filter("lang IS NULL").select("doc_id", "place").collect()
    assert sorted(r.place for r in places) == list(range(8)) and all((r.place < 3) == (r.doc_id is None) for r in places)
    assert merkle.digest(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ search


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    length = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,items,k", [(1 << 20, 1000, 20), (300, 2, 3), (1, 1, 1)])
def test_search_equals_plain_scores(spark, monkeypatch, shard, items, k):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "CUT_BYTES", max(4, shard // 8))
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", items)
    r = random.Random(shard)
    words = ["the", "The", "Ünï", "x1", "don't", "日本", "a_b", "ÄB", "zz"] + [f"w{k}" for k in range(30)]
    docs = [(i if i % 11 else None, " ".join(r.choice(words) for _ in range(r.randrange(25)))) for i in range(80)]
    docs += docs[:9] + [(200, None), (201, ""), (202, "?!\n"), (203, "endless" * 300), (204, "The " * 500)]
    asked = [(k, " ".join(r.choice(words) for _ in range(6))) for k in range(6)] + [(6, "the THE the zz"), (7, None), (8, "--"), (9, "absent"), (None, "x1"), (3, "endless" * 300)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    found = lexical.LexicalIndex.build(table).search(spark.createDataFrame(asked, "item_id long, text string"), k)
    assert [c for c, _ in found.dtypes] == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, asked, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    index = lexical.LexicalIndex.build(docs)
    assert index.search(items.limit(0)).count() == 0 and index.search(items).count() == 1
    assert lexical.LexicalIndex.build(docs.limit(0)).search(items).count() == 0


def test_ties_are_cut_by_id():
    scores, ids = np.array([5, 9, 5, 0, 5, 9]), pa.array([40, 3, 10, 1, None, 2], pa.int64())
    order = lexical._rank_of(ids)
    assert sorted(lexical.top_k(scores, order, 3).tolist()) == [1, 4, 5] and sorted(lexical.top_k(scores, order, 4).tolist()) == [1, 2, 4, 5]
    assert sorted(lexical.top_k(scores, order, 9).tolist()) == [0, 1, 2, 4, 5]


def test_term_counts_of_many_texts():
    texts = [b"", None, b"a b", b"ab", b"--", "é-é 9".encode(), b"x"]
    assert lexical.term_counts(pa.array(texts, pa.binary())).tolist() == [len(lexical.terms_of(t or b"")) for t in texts]
    assert lexical.term_counts(pa.array([], pa.binary())).tolist() == []
    long = ("wörd1 " * 1000 + "x" * 3000 + " y").encode()
    assert [t for p in lexical.pieces_of(long, 100) for t in lexical.terms_of(p)] == lexical.terms_of(long)
