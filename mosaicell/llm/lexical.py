"""Ranked lexical search over document-sharded postings.

The index is a table of shards, a few MB of documents each: the shard's terms, and for each term a
run of postings (document, impact) in CSR form. An impact is a posting's share of a score that no
query changes, an integer computed when the shard is written; term weights come from document
frequencies summed over the shards. A search adds impacts up term at a time in a dense accumulator
over a shard's documents, selects its k best by argpartition with ties cut by document id, and
keeps one list an item and task; the lists are merged by rank in two steps, so that no task gets the
lists of all others.

With the defaults the scores are those of the saturating term frequency that weighs documents by
length: weight floor(1000 ln((2N + 2) / (2df + 1))), impact 10^9 tf div (1000 tf + 12 m) with m = 75 +
25 n N div L. N counts the documents with a term, L all terms, n one document's.

Items are searched in blocks whose terms are bounded (BLOCK_TERMS); each block reads the index
once and is written down, so any number of items fits the driver and the tasks.

Defined results: null texts and those without terms are in the index with no postings, do not count in N, and are found by
nothing; such items find nothing; terms repeated in an item count as often; a row that repeats an item or document
is an item or document of its own; null ids stay null, and among equal scores come first; texts of
any length are cut at other characters, a term of any length is one term; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, slices

#: Bytes of text of a shard, if no single text is longer, and of a text that are split at a time.
SHARD_BYTES, CUT_BYTES = 4 << 20, 4 << 20
#: Distinct terms of the items that are searched at a time, and their number.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 1_000
#: Tasks whose lists are merged in the first step.
MERGE_TASKS = 256
SCALE, DAMP = 1_000_000_000, 12

#: ASCII digits and letters and all bytes of other characters belong to terms.
_IS_TERM = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)][:256])
_IS_TERM[0x80:] = True
#: A to Z become lower case, what belongs to no term a space.
_PLAIN = bytes(ord(chr(b).lower()) if b < 0x80 and _IS_TERM[b] else b if b >= 0x80 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def pieces_of(text: bytes, most: int):
    """A long text in pieces that are cut at no term."""
    start = 0
    while len(text) - start > most:
        end = start + most
        while end < len(text) and _IS_TERM[text[end]]:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def term_counts(texts: pa.Array) -> np.ndarray:
    """The number of terms of each text of a binary array."""
    texts = texts.fill_null(b"")
    ends = np.cumsum([0, *(len(x) for x in texts.to_pylist())])
    mask = _IS_TERM[np.frombuffer(b"".join(texts.to_pylist()), np.uint8)]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    begins[firsts] = mask[firsts]
    sums = np.concatenate([[0], np.cumsum(begins)])
    return sums[ends[1:]] - sums[ends[:-1]]


# ---------------------------------------------------------------- index

SHARD = "doc_ids array<long>, terms binary, starts binary, docs binary, impacts binary"


def _totals(batches):
    n = length = 0
    for batch in batches:
        for start, size in slices(batch.column("text")):
            counts = term_counts(batch.column("text").slice(start, size))
            n, length = n + int((counts > 0).sum()), length + int(counts.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length])], ["n", "length"])


def postings(texts: list[bytes | None], n_docs: int, length: int, cut: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms, starts, documents and impacts of a shard."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    runs, sizes = [], []
    for text in texts:
        own = [np.fromiter(map(known.__getitem__, terms_of(x)), np.int32) for x in pieces_of(text or b"", cut)]
        runs += own
        sizes.append(sum(map(len, own)))
    lengths = np.array(sizes, np.int64)
    keys, tf = np.unique(np.concatenate(runs).astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    terms, docs = np.divmod(keys, len(texts))
    starts = np.searchsorted(terms, np.arange(len(known) + 1))
    m = 75 + 25 * lengths * n_docs // max(1, length)
    impacts = SCALE * tf // (1000 * tf + DAMP * m[docs])
    return list(known), starts.astype(np.int32), docs.astype(np.int32), impacts.astype(np.int32)


def _shards(n_docs: int, length: int, most: int, cut: int):
    def run(batches):
        for batch in batches:
            for start, size in slices(batch.column("text"), most):
                part = batch.slice(start, size)
                terms, *arrays = postings(part.column("text").to_pylist(), n_docs, length, cut)
                ids = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), part.column("doc_id"))
                blobs = [pa.array([x], pa.binary()) for x in (b" ".join(terms), *(a.tobytes() for a in arrays))]
                yield pa.RecordBatch.from_arrays([ids, *blobs], ["doc_ids", "terms", "starts", "docs", "impacts"])

    return run


@dataclass
class LexicalIndex:
    """A table of shards, the number of documents with a term, and that of all terms."""

    shards: DataFrame
    n_docs: int
    length: int

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LexicalIndex:
        rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
        total = rows.select("text").mapInArrow(_totals, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
        n_docs, length = total[0] or 0, total[1] or 0
        return cls(materialize(rows.mapInArrow(_shards(n_docs, length, SHARD_BYTES, CUT_BYTES), SHARD), "lexical-shards"), n_docs, length)

    def frequencies(self, terms: set[bytes]) -> dict[bytes, int]:
        """The number of documents that hold each of the terms."""
        wanted = self.shards.sparkSession.sparkContext.broadcast(terms)
        found = self.shards.select("terms", "starts").mapInArrow(_frequencies(wanted), "term binary, df long")
        rows = found.groupBy("term").agg(F.sum("df").alias("df")).collect()  # as many as terms asked for
        wanted.unpersist()
        return {bytes(r["term"]): r["df"] for r in rows}

    def search(self, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
        """item_id, rank, doc_id, score of the k best documents of each item."""
        spark, path = self.shards.sparkSession, scratch(self.shards.sparkSession, "lexical-found")
        asked = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).cast("binary").alias("text"))
        schema = "item_id long, rank int, doc_id long, score long"
        spark.createDataFrame([], schema).write.parquet(path)
        for block in blocks_of(asked.toLocalIterator()):
            self._search(block, k).write.mode("append").parquet(path)
        return spark.read.schema(schema).parquet(path)

    def _search(self, block: list[tuple[int | None, Counter]], k: int) -> DataFrame:
        context = self.shards.sparkSession.sparkContext
        held = self.frequencies({t for _, terms in block for t in terms})
        weight = {t: int(np.floor(1000 * np.log((2 * self.n_docs + 2) / (2 * df + 1)))) for t, df in held.items()}
        queries = context.broadcast([{t: n * weight[t] for t, n in terms.items() if weight.get(t)} for _, terms in block])
        found = self.shards.mapInArrow(_search(queries, k), "query int, doc_id long, score long")
        best = (F.desc("score"), F.asc_nulls_first("doc_id"))
        near = found.withColumn("part", F.floor(F.spark_partition_id() / MERGE_TASKS))
        for keys in (["query", "part"], ["query"]):
            near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= k)
        names = self.shards.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], "query int, item_id long")
        return near.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def blocks_of(rows):
    """Items with their terms, as many at a time as BLOCK_ITEMS and BLOCK_TERMS allow, or one."""
    block, size = [], 0
    for row in rows:
        terms = Counter(t for x in pieces_of(bytes(row["text"] or b""), CUT_BYTES) for t in terms_of(x))
        if block and (size + len(terms) > BLOCK_TERMS or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], terms))
        size += len(terms)
    if block:
        yield block


# ---------------------------------------------------------------- search


def _frequencies(wanted):
    def run(batches):
        sums: Counter = Counter()
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                own = np.diff(np.frombuffer(starts, np.int32))
                for at, term in enumerate(terms.split(b" ")):
                    if term in wanted.value:
                        sums[term] += int(own[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["term", "df"])

    return run


def top_k(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores above 0; order decides among those equal to the least of them."""
    places = np.flatnonzero(scores > 0)
    if len(places) <= k:
        return places
    own = scores[places]
    least = own[np.argpartition(-own, k - 1)[k - 1]]
    sure, ties = places[own > least], places[own == least]
    return np.concatenate([sure, ties[np.argsort(order[ties], kind="stable")[: k - len(sure)]]])


def _rank_of(ids: pa.Array) -> np.ndarray:
    """The place of each id in ascending order, null first; equal ids in any order."""
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)))] = np.arange(len(ids))
    return rank


def _search(queries, k: int):
    def run(batches):
        kept: dict[int, tuple[np.ndarray, pa.Array]] = {}
        asked = queries.value
        used = {t for q in asked for t in q}
        for batch in batches:
            for at in range(len(batch)):
                ids = batch.column("doc_ids")[at].values
                terms = batch.column("terms")[at].as_py().split(b" ")
                starts, docs, impacts = (np.frombuffer(batch.column(c)[at].as_py(), np.int32) for c in ("starts", "docs", "impacts"))
                own = {t: slice(starts[x], starts[x + 1]) for x, t in enumerate(terms) if t in used}
                order = _rank_of(ids)
                scores = np.zeros(len(ids), np.int64)
                for q, wanted in enumerate(asked):
                    scores[:] = 0
                    for term in wanted.keys() & own.keys():
                        run = own[term]
                        scores[docs[run]] += wanted[term] * impacts[run].astype(np.int64)
                    found = top_k(scores, order, k)
                    if len(found):
                        both = scores[found], ids.take(pa.array(found))
                        if q in kept:
                            both = np.concatenate([kept[q][0], both[0]]), pa.concat_arrays([kept[q][1], both[1]])
                            best = top_k(both[0], _rank_of(both[1]), k)
                            both = both[0][best], both[1].take(pa.array(best))
                        kept[q] = both
        for q, (best, ids) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(best), pa.int32()), ids, pa.array(best)], ["query", "doc_id", "score"])

    return run


ORACLE = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), s AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, docs
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
  ) x GROUP BY ALL
), r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""
