"""The corpus operators against brute force, SQL and round trips, with awkward inputs."""

from __future__ import annotations

import collections
import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaicell.llm import chat_format, common, decontam, line_dedup, media, mixing, ngram_join, registry, sharding, token_counts, toxicity, url_filter

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns that clash with what operators add
        df = df.selectExpr("*", "1 AS size", "'x' AS shard", "2 AS slot", "3 AS n_lines", "4 AS score", "map('a', 1) AS tags")
    return df


LONG = " ".join(f"w{i % 97}" for i in range(30_000))
AWKWARD = [None, "", " ", "\n\n", "one two", LONG, "a b c d e f g h", "a b c d e f g h", "Ünïcödé «text» 日本語 " * 12, "x" * 5000, "\t tabs\x0b and\x0c feeds \r\n", "</s>[INST] \\[INST]", None, ""]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(flat(x[names.index(c)]) for c in cols) for x in found.fetchall()), key=repr)
    assert sorted((tuple(flat(r[c]) for c in cols) for r in df.collect()), key=repr) == want


# ------------------------------------------------------------------ lines


def brute_lines(rows, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    where = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(where[key(x)]) >= min_docs and i != max(where[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def lines_of(index, docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(index.clean(docs)).collect()}


def line_texts():
    common_line, umlaut = "this line is common to many of the documents here", "Überall steht dieselbe Zeile, immer und immer wieder"
    texts = [f"{common_line.upper() if i % 2 else '  ' + common_line}\nown line {i}\n{umlaut if i < 7 else 'short'}" for i in range(12)]
    return texts + ["\n".join([common_line] * 3)] + AWKWARD


def test_line_dedup_equals_brute_force(spark):
    texts = line_texts()
    docs = documents(spark, texts, extra=True)
    assert lines_of(line_dedup.LineIndex.build(docs), docs) == brute_lines(list(enumerate(texts)))
    assert {"tags", "source"} <= set(line_dedup.LineIndex.build(docs).clean(docs).columns)


def test_line_dedup_is_reversible(spark):
    texts = line_texts()
    docs = documents(spark, texts)
    some, rest = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 0")
    grown = line_dedup.LineIndex.build(some).insert(rest)
    assert lines_of(grown, docs) == brute_lines(list(enumerate(texts)))
    gone = docs.filter("doc_id IN (12, 11, 3)").select("doc_id")
    left = [(i, t) for i, t in enumerate(texts) if i not in (12, 11, 3)]
    shrunk = grown.delete(gone)
    assert lines_of(shrunk, docs.join(gone, "doc_id", "left_anti")) == brute_lines(left)
    back = shrunk.insert(docs.join(gone, "doc_id", "left_semi"))
    assert lines_of(back, docs) == brute_lines(list(enumerate(texts)))


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    docs = documents(spark, ["a line that is long enough to be a key, surely"] * 6)
    twice = docs.unionByName(docs)
    rows = line_dedup.digest(line_dedup.LineIndex.build(twice).clean(twice)).collect()
    assert len(rows) == 12 and {r.n_dropped for r in rows if r.doc_id == 5} == {0} and {r.n_dropped for r in rows if r.doc_id < 5} == {1}
    none = docs.limit(0)
    assert line_dedup.LineIndex.build(none).clean(none).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(0)
    k = rng.integers(-(2**62), 2**62, (5000, 2))
    f = line_dedup.CuckooFilter.built(k[:, 0], k[:, 1])
    assert f.contains(k[:, 0], k[:, 1]).all()
    other = rng.integers(-(2**62), 2**62, (20000, 2))
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.002
    assert all(f.delete(int(a), int(b)) for a, b in k[:2500])
    assert f.contains(k[2500:, 0], k[2500:, 1]).all() and f.contains(k[:2500, 0], k[:2500, 1]).mean() < 0.01
    again = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert (again.table == f.table).all()


# ------------------------------------------------------------------ near duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        words = [w.decode() for w in (t or "").encode().lower().split()]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts():
    rng = np.random.default_rng(7)
    word = lambda: f"v{rng.integers(5000)}"
    out = []
    shared = [word() for _ in range(60)]
    for _ in range(6):
        base = [word() for _ in range(int(rng.integers(40, 200)))]
        for _ in range(12):  # copies with many, few or no edits, around the threshold
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[rng.integers(len(copy))] = word()
            out.append(" ".join(copy))
    for _ in range(25):  # a passage that many unrelated documents share
        out.append(" ".join([word() for _ in range(30)] + shared + [word() for _ in range(30)]))
    for n in range(1, 9):
        out += [" ".join(f"s{i}" for i in range(n)), " ".join(f"S{i}" for i in range(n)) + "\n"]
    return out + AWKWARD


def test_ngram_join_equals_brute_force(spark):
    texts = near_texts()
    docs = documents(spark, texts, extra=True)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.label(docs).collect()}
    assert got == brute_components(texts)
    kept = {r.doc_id for r in ngram_join.keep_first(docs).collect()}
    assert kept == {i for i, (_, c) in brute_components(texts).items() if c == i}


def test_ngram_join_of_a_large_near_group(spark):
    """Members far from the hub link among themselves; all pairs are never made."""
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        copy = list(base)
        for k in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            copy[k] = f"e{i}x{k}" if rng.random() < 0.5 else f"e{k}"
        texts.append(" ".join(copy))
    docs = documents(spark, texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.label(docs).collect()} == brute_components(texts)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.label(documents(spark, ["x"]).limit(0)).count() == 0
    assert [r.component_id for r in ngram_join.label(documents(spark, [None, ""])).collect()] in ([0, 1], [1, 0])


# ------------------------------------------------------------------ toxicity


def toxic_data(spark, n=600):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 60)) + list(rng.choice(["the", "and", "of", "to"], 8))
        bad = i % 4 == 0
        if bad:
            words[rng.integers(60)] = ["grobian", "schuft", "lump"][i % 3] + ["", "en", "er"][i % 2]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_generalises_and_is_calibrated(spark):
    docs, labels = toxic_data(spark)
    rows = toxicity.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95


def test_toxicity_of_awkward_texts(spark):
    docs, labels = toxic_data(spark, 200)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "x")], "doc_id long, text string")
    rows = toxicity.classify(docs.unionByName(odd), labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (99999, 0, 1)], labels.schema))).collect()
    assert len(rows) == 200 + len(AWKWARD) + 1 and all(r.score is not None for r in rows)
    constant = toxicity.classify(docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in constant} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


# ------------------------------------------------------------------ sharding


def test_external_shuffle(spark):
    texts = [f"text {i} " * (i % 50) for i in range(400)] + AWKWARD + ["same"] * 200
    docs = documents(spark, texts, extra=True)
    rows = sharding.external_shuffle(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and all(r.text == texts[r.doc_id] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs.repartition(7)).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs, seed=8).collect()}
    assert other != again
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15


def test_external_shuffle_equals_a_serial_one(spark):
    """Scatter by the chained 64-bit hash, sort and permute each bucket, and number the records."""
    import struct

    import xxhash

    texts = [f"text {i}" for i in range(500)] + AWKWARD + ["same"] * 30
    docs = documents(spark, texts)
    buckets = collections.defaultdict(list)
    for i, t in enumerate(texts):
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", 7), 42))
        h = xxhash.xxh64_intdigest(t.encode(), h) if t is not None else h
        buckets[(h - (h >> 63 << 64)) % 256].append(i)
    want, before = {}, 0
    for b in sorted(buckets):
        places = list(range(len(buckets[b])))
        rng = np.random.default_rng((7, b))
        tops = np.arange(len(places) - 1, 0, -1)
        for i, j in zip(tops, rng.integers(0, tops + 1) if len(tops) else [], strict=True):
            places[i], places[j] = places[j], places[i]
        for i, place in zip(sorted(buckets[b]), places, strict=True):
            want[i] = ((before + place) % 24, (before + place) // 24)
        before += len(places)
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.external_shuffle(docs).collect()} == want


def test_offsets_over_many_blocks(spark):
    rows = [(i, (i * 7) % 5) for i in range(0, 3 * sharding.BLOCK, 3)]
    got = {r.bucket: r.before for r in sharding.offsets(spark.createDataFrame(rows, "bucket int, n long")).collect()}
    sums = np.cumsum([0, *[n for _, n in rows]])
    assert got == {b: int(s) for (b, _), s in zip(rows, sums[:-1], strict=True)}


def test_external_shuffle_of_repeated_rows_and_nothing(spark):
    docs = documents(spark, ["a"] * 5)
    many = docs.unionByName(docs).unionByName(docs)
    assert len({(r.shard, r.slot) for r in sharding.external_shuffle(many).collect()}) == 15
    assert sharding.external_shuffle(docs.limit(0)).count() == 0


def test_fisher_yates_is_uniform():
    counts = collections.Counter(tuple(sharding.fisher_yates(3, (1, i))) for i in range(3000))
    assert len(counts) == 6 and min(counts.values()) > 400


# ------------------------------------------------------------------ urls


URLS = [None, "", "no scheme", "http://a.net/x", "http://a.net", "https://EXAMPLE.net/en/1?x#y", "http://example.net/fr/", "ftp://b.example.com/de/2", "http://example.com/de", "http://x.org/fr/3#t", "http://org/fr/", "http://notexample.com/de/1", "a://b://c/d", "http://host?q=/de/", "http://Ünï.net/ä?ö", "http://" + "a" * 4000 + ".com/" + "1/" * 500]


def test_url_rules_equal_brute_force(spark):
    def brute(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None

    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = url_filter.judge(pages, url_filter.Boosted()).collect()
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert len(rows) == len(URLS)


def test_url_trees_learn_lexical_signs(spark):
    rng = np.random.default_rng(0)
    name = lambda: "".join(rng.choice(list("abcdefghij"), 8))
    rows = [(f"http://{name()}.example.com/en/{i}", 0) for i in range(300)] + [(f"http://{name()}-{name()}.example.com/en/{i}?a=1&b=2", 1) for i in range(60)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, label int"), trees=4)
    fresh = [(i, f"http://{name()}-{name()}.example.org/en/{i}" if i % 2 else f"http://{name()}.example.org/en/{i}") for i in range(40)]
    got = url_filter.judge(spark.createDataFrame(fresh, "page_id long, url string"), model, ()).collect()
    assert np.mean([(r.verdict == "block") == bool(r.page_id % 2) for r in got]) > 0.9
    plan = url_filter.judge(spark.createDataFrame(fresh, "page_id long, url string"), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rare_suffixes_keep_their_statistics(spark):
    kind = np.random.default_rng(5).integers(0, 2, 1300).tolist()
    rows = [(f"http://h.s{i:04d}.info/a", kind[i]) for i in range(1300) for _ in range(3 if i < 1000 else 2)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, label int"), trees=3)
    pages = spark.createDataFrame([(i, f"http://h.s{i:04d}.info/a") for i in range(1000, 1300)], "page_id long, url string")
    got = {r.page_id: r.verdict == "block" for r in url_filter.judge(pages, model).collect()}
    assert got == {i: bool(kind[i]) for i in range(1000, 1300)}


# ------------------------------------------------------------------ decontamination


ITEM = "In spring the farmer Berta Frank counted 99 apples and gave 5 kg of them to Otto before the market opened. Then Otto sold 3 kg."


@pytest.mark.parametrize("limit", [10**6, 0])
def test_templates_catch_new_parameters(spark, limit):
    docs = {
        1: "Some text first. " + ITEM + " And more.",
        2: "Filler words. In spring the farmer Carla Stone counted 40 apples and gave 7kg of them to Georg before the market opened. Then Georg sold 12 kg.",
        3: ITEM.lower().replace(",", " "),
        4: "In spring the farmer sat down and wrote a long letter about apples, kg and markets to nobody at all.",
        5: None, 6: "", 7: ITEM[:40],
        8: "In spring the farmer Berta Frank counted 99 apples and gave 5 kg of them to Otto before the market opened. Then Otto sold 3 kg. " * 3,
    }
    bench = spark.createDataFrame([(10, ITEM, "x"), (11, None, "x"), (12, "too short", "x"), (13, "five plain words stand here", "x")], "item_id long, text string, h string")
    rows = decontam.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench, limit).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 10), (2, 10), (3, 10), (8, 10)}
    assert {r.doc_id: r.changed_slots for r in rows}[1] == 0 and {r.doc_id: r.changed_slots for r in rows}[2] >= 4


def test_slots_must_be_consistent(spark):
    item = "Maria gave the ball to Peter and then Peter gave the ball to Maria while Klaus looked at Peter again"
    clash = "Anna gave the ball to Bert and then Carl gave the ball to Dora while Emil looked at Fritz again"
    same = "Anna gave the ball to Bert and then Bert gave the ball to Anna while Emil looked at Bert again"
    bench = spark.createDataFrame([(1, "So " + item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "So " + clash), (2, "So " + same)], "doc_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(docs, bench).collect()} == {2}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_units_that_the_benchmark_lacks_are_slots(spark, limit):
    bench = spark.createDataFrame([(1, "on monday the old red bus drove 12 miles along the river before it stopped")], "item_id long, text string")
    texts = {1: "on monday the old red bus drove 20 km along the river before it stopped", 2: "on monday the old red bus drove 20km along the river before it stopped", 3: "on monday the old red bus drove some km along a river"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decontam.find_leaks(docs, bench, limit).collect()
    assert {(r.doc_id, r.n_windows, r.item_windows, r.changed_slots) for r in rows} == {(1, 8, 8, 2), (2, 8, 8, 2)}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_items_of_values_and_short_items_are_found_verbatim(spark, limit):
    items = {1: "Compute 12 + 30 + 18 + 25 + 43 + 76 + 91 + 8", 2: "7 kg", 3: "Solve 3 4 5", 4: "+ -", 5: "1 2 3 4 5 6 7 8 9 10 11 the sum of all the numbers here is asked"}
    items |= {6: "the", 7: "Yes"}  # as windows they would be in any text
    texts = {
        1: "Some words. " + items[1] + " and more words.", 2: "Compute 12 + 30 + 18 + 25 + 44 + 77 + 92 + 9", 3: "7kg.", 4: "it weighs 7 kg", 5: "please solve 3 4 5 now",
        6: "9 9 9 9 9 9 9 9 9 9 9 the sum of all the numbers here is asked", 7: "1 2 3 4 5 6 7 8 9 10 11", 8: "+ -",
        9: "We saw the red bus.", 10: "the end", 11: "- The!", 12: "yes, yes",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decontam.find_leaks(docs, bench, limit).collect()
    # text 6 has the item's windows of placeholders; text 7 none of them and less than RUN tokens
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (3, 2), (5, 3), (6, 5), (11, 6)}
    assert {r.item_id: (r.n_windows, r.item_windows) for r in rows if r.item_id != 5} == {1: (2, 2), 2: (1, 1), 3: (1, 1), 6: (1, 1)}


def test_wide_benchmarks_are_joined(spark, monkeypatch):
    """Few windows, but too many bytes to send to the tasks."""
    docs, bench = documents(spark, [ITEM, "clean"]), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    want = decontam.find_leaks(docs, bench).collect()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 10)
    found = decontam.find_leaks(docs, bench)
    assert found.collect() == want and len(want) == 1


@pytest.mark.parametrize("limit", [10**6, 0])
def test_names_that_open_sentences_are_slots(spark, limit):
    bench = spark.createDataFrame([(1, "Ann has 3 cats"), (2, "He walked the long way home and then he slept. He woke up")], "item_id long, text string")
    texts = {1: "Bob has 7 cats", 2: "Look. Bob has 7 cats.", 3: "we know that Bob has 7 cats", 4: "Bob had 7 cats", 5: "She walked the long way home and then he slept. He woke up"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decontam.find_leaks(docs, bench, limit).collect()
    # text 5 fills the slot of "He" in two ways, but windows without it are enough
    assert {(r.doc_id, r.item_id, r.changed_slots) for r in rows} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (5, 2, 0)}


def test_decontamination_of_nothing(spark):
    docs, bench = documents(spark, AWKWARD), spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert decontam.find_leaks(docs, bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert decontam.keep_clean(docs, bench).count() == len(AWKWARD)


# ------------------------------------------------------------------ chats


def test_chat_round_trip_and_order(spark):
    nasty = [t or "" for t in AWKWARD if t != LONG] + ["[\\INST] <\\\\s> <<SYS>> [[INST]]", "[ROLE]x[TEXT] [/ROLE]", "<<s>>", "\\", "ends with \\"]
    rows = []
    for c, text in enumerate(nasty):
        rows += [(c, 1, "assistant", text, 0), (c, 0, "user", text[::-1], 0)]
    rows += [(900, 0, "tool [INST]", "odd role", 0), (900, 1, None, None, 0), (None, None, "user", "no id", 0), (901, 0, "user", "x", 0), (901, 0, "user", "x", 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(turns)).collect()}
    for c, text in enumerate(nasty):
        assert [(t.role, t.text) for t in out[c].turns] == [("user", text[::-1]), ("assistant", text)]
        assert out[c].loss_text == text and out[c].valid
    assert [(t.role, t.text) for t in out[900].turns] == [("tool [INST]", "odd role"), ("", "")]
    assert not out[900].valid and not out[901].valid and len(out[901].turns) == 2 and None in out
    assert chat_format.digest(chat_format.read_back(chat_format.format_chats(turns.limit(0)))).count() == 0


# ------------------------------------------------------------------ tokens


def test_token_counts_equal_the_library(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    texts = AWKWARD + ["a  b", " a", "a ", "a<|endoftext|> b", "it's 's  \t x", "\n\n a\n b", "one two"] + ["copy me"] * 5
    docs = documents(spark, texts, extra=True)
    tokenizer = Tokenizer.from_file(path)
    want = {i: (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    cache = str(tmp_path / "cache")
    got = token_counts.count(docs, path, cache).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(texts)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})
    more = documents(spark, [*texts, "a new text"])
    assert token_counts.count(more, path, cache).count() == len(texts) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    # what is stored is not encoded again, nothing is appended, and no more of the cache is kept than is wanted
    folders = sorted(Path(cache).glob("run=*"))
    kept = []
    monkeypatch.setattr(token_counts, "materialize", lambda df, name: (kept.append((name, (out := common.materialize(df, name)).count())), out)[1])
    assert token_counts.count(more.filter("doc_id = 4"), path, cache).first().n_tokens == want[4][1]
    assert sorted(Path(cache).glob("run=*")) == folders and kept == [("token-digests", 1), ("token-hits", 1)]
    token_counts.compact(spark, cache)
    assert len(list(Path(cache).glob("run=*/*.parquet"))) and len([f for f in Path(cache).glob("run=*") if list(f.glob("*.parquet"))]) == 1
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count(docs, path, cache).collect()} == want
    token_counts.compact(spark, str(tmp_path / "absent"))
    assert token_counts.count(docs.limit(0), path, str(tmp_path / "none")).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_token_query_reuses_its_cache(spark):
    rows = [sorted(map(tuple, registry.op8_token_counts(spark, str(DATA)).collect()))]
    cache = registry.token_cache(spark, registry.tokenizer_path())
    stored = spark.read.parquet(cache).count()
    assert stored == common.table(spark, str(DATA), "documents").select(F.coalesce("text", F.lit(""))).distinct().count()
    rows.append(sorted(map(tuple, registry.op8_token_counts(spark, str(DATA)).collect())))
    assert rows[0] == rows[1] and spark.read.parquet(cache).count() == stored


def test_token_counts_of_runs_at_one_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path, cache = registry.tokenizer_path(), str(tmp_path / "cache")
    tables = [documents(spark, [f"run {k} text {i}" for i in range(50)] + ["both"]) for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        sizes = list(pool.map(lambda t: token_counts.count(t, path, cache).count(), tables))
    stored = spark.read.parquet(cache)
    assert sizes == [51] * 4 and stored.select("digest").distinct().count() == 201
    assert token_counts.count(tables[0], path, cache).count() == 51


# ------------------------------------------------------------------ media


def scene(rng, n=80):
    x = rng.normal(0, 1, (n, n))
    for _ in range(3):
        for axis in (0, 1):
            x = sum(np.roll(x, k, axis) for k in (-1, 0, 1)) / 3
    return np.clip(128 + x / x.std() * 50, 0, 255)


def test_media_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(12):
        s = scene(rng)
        edit = [s[8:70, 10:76], np.clip(s * 0.8 + 20 + rng.normal(0, 3, s.shape), 0, 255), np.rot90(s), s.copy(), np.kron(s, np.ones((2, 2)))][i % 5]
        if i % 5 == 1:
            edit[50:70, 50:70] = 10
        rows += [(10 * i, s), (10 * i + 1, edit)]
    data = [(i, bytearray(media.encode_pgm(x))) for i, x in rows] + [(900, None), (901, bytearray(b"zz")), (902, bytearray(b"zz")), (903, bytearray(media.encode_pgm(np.full((40, 40), 7)))), (None, bytearray(b"zz"))]
    out = media.copies(spark.createDataFrame(data, "id long, media binary")).collect()
    got = {r.id: r.class_id for r in out}
    assert np.mean([got[10 * i + 1] == 10 * i for i in range(12)]) >= 0.9
    assert all(c is None or c // 10 == i // 10 or i >= 900 for i, c in got.items() if i is not None)
    assert (got[900], got[901], got[902], got[903]) == (900, 901, 901, 903)
    assert media.copies(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_copies_of_a_picture_are_one_class(spark):
    whole = scene(np.random.default_rng(3))
    data = []
    for i in range(7):  # each has an edit of its own
        x = whole.copy()
        x[3 + 9 * i : 9 + 9 * i, 3:9] = 128
        data.append((i, bytearray(media.encode_pgm(x))))
    data.append((7, bytearray(media.encode_pgm(scene(np.random.default_rng(4))))))
    got = {r.id: (r.class_id, r.class_size) for r in media.copies(spark.createDataFrame(data, "id long, media binary")).collect()}
    assert got == {i: (0, 7) for i in range(7)} | {7: (7, 1)}


# ------------------------------------------------------------------ mixing


def test_mixing_meets_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), None if i % 10 == 0 else f"s{(i * i) % 4}") for i in range(800)] + [(900 + i, t, "odd") for i, t in enumerate(AWKWARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS copies")
    out = mixing.mix(docs).collect()
    total = collections.Counter()
    taken, target, sizes, largest = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in out:
        assert r.size == len((r.text or "").encode().split()) and r.taken <= 2 * r.size and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    total = sum(sizes.values())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want, left, weights = {}, 1.5 * total, {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    todo = set(names)
    while True:
        level = left / sum(weights[s] for s in todo)
        over = [s for s in todo if level * weights[s] >= 2 * sizes[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            todo.remove(s)
    want |= {s: level * weights[s] for s in todo}
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= largest[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    assert mixing.expand(mixing.mix(docs)).count() == sum(r.copies for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_is_native(spark):
    mixed = mixing.mix(documents(spark, AWKWARD))
    assert "Python" not in mixed._jdf.queryExecution().toString()


# ------------------------------------------------------------------ pipeline


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = common.table(spark, str(DATA), "documents")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, str(DATA)), f"test-{name}")
        sizes.append(docs.count())
        if name == "ngram_join":
            got = {r.doc_id for r in docs.collect()}
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            comp = brute_components([t for _, t in rows])
            assert got == {rows[i][0] for i, (_, c) in comp.items() if c == i}
        if name == "decontamination":
            gone = {r.doc_id for r in decontam.find_leaks(before, common.table(spark, str(DATA), "benchmark")).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - gone
        if name != "sharding":
            assert docs.columns == before.columns
    assert set(docs.columns) - set(before.columns) == {"shard", "slot"}
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[5] == sizes[4] > 0


def test_helpers_leave_no_shuffle_setting_behind(spark):
    before = spark.conf.get(common.CLEANUP, None)
    common.materialize(spark.range(3).groupBy("id").agg(F.count("*")), "x")
    assert spark.conf.get(common.CLEANUP, None) == before


def test_labelled_urls(spark):
    pages = spark.createDataFrame([(1, "http://casino.example.com/en/5"), (2, "http://x.example.com/en/7.html?p=8"), (3, "http://y.example.com/en/8"), (4, None), (5, "http://z.example.com/en/")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (8, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, url_filter.labelled_urls(pages, labels).collect()))
    assert got == [("http://casino.example.com/en/5", 0), ("http://x.example.com/en/7.html?p=8", 0), ("http://y.example.com/en/8", 1)]
    assert url_filter.train(url_filter.labelled_urls(pages.filter("page_id > 2"), labels)).trees == []


def test_chat_queries_are_native(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat_format.digest(chat_format.read_back(chat_format.format_chats(turns)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_toxicity_learns_from_all_labelled_rows(spark, monkeypatch):
    """The word that tells texts of one kind apart is in long texts and in rows beyond any sample; parts give the same model
    each time, and their presences are those of all rows."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 150)
    docs, labels = toxic_data(spark, 1500)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 2, F.concat(F.lit("halunke "), F.repeat(F.lit("the of and "), 3000))).otherwise(F.col("text")))
    labels = labels.withColumn("toxic", F.when(F.col("doc_id") % 4 == 2, 1).otherwise(F.col("toxic")))
    rows = toxicity.labelled(docs, labels)
    want = {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert rows.count() == len(want) and 0 < rows.filter("fold = 0").count() < len(want) / 3
    seen = []
    monkeypatch.setattr(toxicity, "evidence", lambda s, n, f=toxicity.evidence: seen.append((s, n)) or f(s, n))
    model, again = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), labels)
    assert np.array_equal(model.emb, again.emb) and np.array_equal(model.shift, again.shift)
    found = rows.filter("fold <> 0").collect()
    words, feats, _ = toxicity.tokenised([r.text for r in found])
    counts, n = toxicity.presences(words, feats, np.array([r.toxic for r in found]))
    assert np.array_equal(seen[0][0], counts) and seen[0][1].tolist() == n.tolist()
    got = toxicity.score(docs, model).collect()
    right = [(r.score >= 0.7) == (r.doc_id % 2 == 0) for r in got if r.doc_id not in want]
    assert np.mean(right) > 0.95
