"""Reversible line dedup: exact reference counts behind sharded cuckoo filters.

State, by key (128 bits of xxh3 of the normalised line):

* ``postings(k1, k2, doc_id)``: which document holds which key; what makes a deletion exact;
* ``refcounts(k1, k2, refs, keeper)``: number of documents and the largest doc_id;
* ``filters(shard, keys, blob)``: a cuckoo filter for each shard of the key space, holding the
  keys found in at least ``min_docs`` documents. A cuckoo filter can delete, so a document's
  removal takes keys out again; a filter that overflows is rebuilt from the counts, twice as large.

`insert` and `delete` change the counts of the touched keys only. To clean a table, its postings
stream past the filter of their shard (hot shards are split by a salt of the document, so one very
common line spreads over many tasks); what passes is checked against the exact counts; documents
then lose the lines found, joined by doc_id.

Defined results: a null or empty text is one empty line, which is shorter than any key; rows
repeated with one doc_id count as one document and lose the same lines; a null doc_id is one
document, below all others, to insert and delete too; an empty table gives an empty result; further
columns are kept, but for n_lines and n_dropped, which are replaced. Of documents that tie for a line the
largest doc_id keeps it; within one document all its lines of a key share their fate. Long texts are split whole, alone in
their slice, and a line of any length is one key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, slices

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS, MIN_SHARDS, SALTS = 100_000, 16, 32
SPACE = b" \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- filter


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, 4 slots a bucket, two buckets a key."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, len(table) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 4
        while buckets * cls.SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    @classmethod
    def built(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        room = len(k1)
        while True:
            out = cls.sized(room)
            if all(out.insert(a, b) for a, b in zip(k1.tolist(), k2.tolist(), strict=True)):
                return out
            room = max(8, 2 * room)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def _places(self, k1, k2):
        fp = k2 & 0xFFFF
        fp = fp | (fp == 0)
        one = k1 & self.mask
        return fp, one, one ^ (fp * 0x5BD1 & self.mask)

    def insert(self, k1: int, k2: int) -> bool:
        fp, one, two = self._places(k1, k2)
        fp = int(fp)
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        at = two
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at ^= fp * 0x5BD1 & self.mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        return False

    def delete(self, k1: int, k2: int) -> bool:
        fp, one, two = self._places(k1, k2)
        for at in (one, two):
            found = np.flatnonzero(self.table[at] == fp)
            if len(found):
                self.table[at, found[0]] = 0
                return True
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, one, two = self._places(k1, k2)
        fp = fp.astype(np.uint16)[:, None]
        return (self.table[one] == fp).any(1) | (self.table[two] == fp).any(1)


# ---------------------------------------------------------------- lines


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of the normalised line, or None if it is too short. bytes.strip and bytes.lower
    know ASCII only, as the contract does."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _postings(min_chars: int):
    def run(batches):
        for batch in batches:
            for start, length in slices(batch.column("text")):
                owners, keys = [], []
                for at, text in enumerate(batch.column("text").slice(start, length).to_pylist(), start):
                    found = {k for k in (line_key(x, min_chars) for x in (text or b"").split(b"\n") if len(x) >= min_chars) if k}
                    keys.extend(found)
                    owners.extend([at] * len(found))
                k = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), batch.column("doc_id").take(pa.array(owners, pa.int64()))], ["k1", "k2", "doc_id"])

    return run


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_postings(min_chars), "k1 long, k2 long, doc_id long").distinct()


def _rewrite(min_chars: int, names: list[str], drops: str):
    """drops: the column with the keys that a document loses."""

    def run(batches):
        for batch in batches:
            for start, length in slices(batch.column("text")):
                part, texts, n_lines, n_dropped = batch.slice(start, length), [], [], []
                for text, gone in zip(part.column("text").to_pylist(), part.column(drops).to_pylist(), strict=True):
                    n, dropped = (text or b"").count(b"\n") + 1, 0
                    if gone:
                        gone = {int(a).to_bytes(8, "big", signed=True) + int(b).to_bytes(8, "big", signed=True) for a, b in ((x["k1"], x["k2"]) for x in gone)}
                        kept = [x for x in text.split(b"\n") if len(x) < min_chars or line_key(x, min_chars) not in gone]
                        dropped, text = n - len(kept), b"\n".join(kept)
                    texts.append(text)
                    n_lines.append(n)
                    n_dropped.append(dropped)
                new = {"text": pa.array(texts, pa.binary()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(n, part.column(n) if n in part.schema.names else None) for n in names], names)

    return run


# ---------------------------------------------------------------- state


class LineIndex:
    """Reference counts and filters over a set of documents; insert and delete give a new one."""

    def __init__(self, posts: DataFrame, refs: DataFrame, filters: DataFrame, shards: int, min_docs: int, min_chars: int):
        self.posts, self.refs, self.filters = posts, refs, filters
        self.shards, self.min_docs, self.min_chars = shards, min_docs, min_chars

    @staticmethod
    def _count(posts: DataFrame) -> DataFrame:
        return posts.groupBy("k1", "k2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("keeper"))

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        posts = materialize(postings(docs, min_chars), "line-postings")
        refs = materialize(cls._count(posts), "line-refs")
        heavy = refs.filter(F.col("refs") >= min_docs)
        shards = max(MIN_SHARDS, -(-heavy.count() // SHARD_KEYS))
        filters = materialize(heavy.groupBy(_shard(shards).alias("shard")).applyInArrow(_build_filter, "shard int, keys long, blob binary"), "line-filters")
        return cls(posts, refs, filters, shards, min_docs, min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        held = self.posts.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("doc_id").alias("holder"))
        same = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("holder"))
        fresh = postings(docs, self.min_chars).join(held, same, "left_anti")
        return self._changed(self.posts.unionByName(fresh), fresh)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("deleted")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("deleted"))
        return self._changed(self.posts.join(ids, same, "left_anti"), self.posts.join(ids, same, "left_semi"))

    def _changed(self, posts: DataFrame, moved: DataFrame) -> LineIndex:
        """Count the touched keys anew, from their postings, and tell each filter what became of them."""
        posts = materialize(posts, "line-postings")
        touched = materialize(moved.select("k1", "k2").distinct(), "line-touched")
        new = materialize(self._count(posts.join(touched, ["k1", "k2"], "left_semi")), "line-touched-refs")
        refs = materialize(self.refs.join(touched, ["k1", "k2"], "left_anti").unionByName(new), "line-refs")
        held = lambda df: df.filter(F.col("refs") >= self.min_docs).select("k1", "k2")
        old = held(self.refs.join(touched, ["k1", "k2"], "left_semi"))
        steps = held(new).join(old, ["k1", "k2"], "left_anti").withColumn("step", F.lit(1)).unionByName(old.join(held(new), ["k1", "k2"], "left_anti").withColumn("step", F.lit(-1)))
        steps = steps.withColumn("shard", _shard(self.shards))
        everyone = self.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInArrow(_update_filter, "shard int, keys long, blob binary")
        filters = materialize(everyone, "line-filters")
        full = filters.filter(F.col("blob").isNull()).select("shard")
        again = held(refs).withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_build_filter, "shard int, keys long, blob binary")
        filters = materialize(filters.filter(F.col("blob").isNotNull()).unionByName(again), "line-filters")
        return LineIndex(posts, refs, filters, self.shards, self.min_docs, self.min_chars)

    def drops(self) -> DataFrame:
        """doc_id, k1, k2 of the lines that go: all but the largest document of each key."""
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        rows = self.posts.select(_shard(self.shards).alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("blob"), "k1", "k2", "doc_id")
        none = [F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "doc_id")]
        heads = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "blob", *none)
        # the filter sorts before the rows of its shard
        stream = heads.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("blob").isNull())
        maybe = stream.mapInArrow(_probe, "k1 long, k2 long, doc_id long")
        heavy = self.refs.filter(F.col("refs") >= self.min_docs).select("k1", "k2", "keeper")
        return maybe.join(heavy.hint("merge"), ["k1", "k2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "k1", "k2")

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs with the kept text, n_lines and n_dropped. docs must be among those indexed."""
        docs = docs.drop("n_lines", "n_dropped")
        drops, owner = free_name(docs, "line_drops"), free_name(docs, "line_owner")
        gone = self.drops().groupBy(F.col("doc_id").alias(owner)).agg(F.collect_list(F.struct("k1", "k2")).alias(drops))
        joined = docs.withColumn("text", F.col("text").cast("binary")).join(gone.hint("merge"), docs["doc_id"].cast("long").eqNullSafe(F.col(owner)), "left").drop(owner)
        names = [*docs.columns, "n_lines", "n_dropped"]
        kinds = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema.fields)
        out = joined.mapInArrow(_rewrite(self.min_chars, names, drops), f"{kinds}, n_lines long, n_dropped long")
        return out.withColumn("text", F.col("text").cast("string"))


def _shard(shards: int) -> F.Column:
    return F.pmod(F.shiftright("k1", 32), F.lit(shards)).cast("int")


def _build_filter(key, keys):
    made = CuckooFilter.built(keys["k1"].to_numpy(), keys["k2"].to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([len(keys)], pa.int64()), "blob": pa.array([made.to_bytes()], pa.binary())})


def _update_filter(key, filters, steps):
    """A null blob asks for a rebuild."""
    n = filters["keys"][0].as_py() if len(filters) else 0
    made = CuckooFilter.from_bytes(filters["blob"][0].as_py()) if len(filters) else CuckooFilter.sized(len(steps))
    fits = True
    for k1, k2, step in zip(steps["k1"].to_pylist(), steps["k2"].to_pylist(), steps["step"].to_pylist(), strict=True):
        fits &= made.insert(k1, k2) if step > 0 else made.delete(k1, k2)
        n += step
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([n], pa.int64()), "blob": pa.array([made.to_bytes() if fits else None], pa.binary())})


def _probe(batches):
    """Rows come ordered: each shard's filter, then what is to be looked up in it. A shard without
    a filter has no key that is common enough."""
    shard, held = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        for start, end in _runs(shards):
            part = batch.slice(start, end - start)
            if shards[start] != shard:
                shard, held = shards[start], None
            blob = part.column("blob").drop_null()
            if len(blob):
                held = CuckooFilter.from_bytes(blob[0].as_py())
            if held is None:
                continue
            rows = pa.Table.from_batches([part]).filter(part.column("blob").is_null()).select(["k1", "k2", "doc_id"])
            if len(rows):
                rows = rows.filter(pa.array(held.contains(rows["k1"].to_numpy(), rows["k2"].to_numpy())))
                yield from rows.to_batches()


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, t.i, t.line, translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) t
), c AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM l LEFT JOIN c ON l.k = c.k
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
