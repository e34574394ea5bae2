"""Token counts with a digest cache.

A text is known by the sha256 of its normalised content (null becomes empty; the tokenizer's own
normaliser is part of its version, so no other change is made that could alter a count), and a
tokenizer by the sha256 of its file. Stored counts are joined by both: of the cache only the digests
that are wanted go on, so a small increment costs a scan of the cache's columns and no shuffle of it. Only distinct texts that
the cache lacks are encoded, and their counts are appended to it. Copies therefore cost one
encoding however many there are. Each run that encodes anything appends a folder of its own, so runs at one time do not
touch each other's files; what both encode is stored twice with the same count, until `compact`
joins the folders.

Tokenizers are files of the tokenizers library (.json) or of sentencepiece (.model). A byte-level
pre-tokenizer with its own pattern always starts a new piece at a space between two characters that
are not white space, so inside a task the encoder then works on the pieces of a text between single
spaces: counts add up, and the count of each distinct piece is remembered. Texts in which white
space meets a space are cut at the other spaces only. The memo is bounded. With any other tokenizer
(`splits_at_spaces`) whole texts are encoded.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and ties of digests give a row
each; a null doc_id stays null; texts of any length are encoded whole, those beyond a slice alone; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cleanup, join_small, materialize, slices

#: Pieces that a worker remembers before it starts anew, and their greatest length.
MEMO_PIECES, MEMO_CHARS = 400_000, 64
_memos: dict[str, tuple] = {}
#: A space between two characters that are no white space: a place where texts may be cut.
CUT = re.compile(r"(?<=\S) (?=\S)")


def version_of(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def splits_at_spaces(spec: dict) -> bool:
    """Whether counts of the pieces between lone spaces add up to the text's, by a tokenizer's json:
    nothing but a byte-level pre-tokenizer with its own pattern may look at the text before the model,
    and no added token may reach over a space."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    added = any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or ())
    return plain and not spec.get("normalizer") and not added


def _encoder(path: str, version: str):
    """The worker's encoder, a function from texts to counts, and its memo or None."""
    if version not in _memos:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            _memos[version] = (lambda texts: [len(x) for x in pieces.encode(texts)], None)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            _memos[version] = (lengths, {} if splits_at_spaces(json.loads(tokenizer.to_str())) else None)
    return _memos[version]


def count_tokens(texts: list[str], path: str, version: str) -> list[int]:
    lengths, memo = _encoder(path, version)
    if memo is None:
        return lengths(texts)
    if len(memo) > MEMO_PIECES:
        memo.clear()
    rows = [text.split(" ") for text in texts]
    heads = [row.pop(0) for row in rows]
    missing = [x for x in set().union(*rows) if x not in memo]
    counts = lengths([" " + x for x in missing])
    # None: white space meets the space here, so that its texts can't be cut at every space
    fresh = {x: n if x and not x[0].isspace() and not x[-1].isspace() else None for x, n in zip(missing, counts, strict=True)}
    memo.update(fresh)
    out = []
    for text, head, row, n in zip(texts, heads, rows, lengths(heads), strict=True):
        try:
            if row and (not head or head[-1].isspace()):
                raise TypeError
            out.append(n + sum(map(memo.__getitem__, row)))
        except TypeError:
            first, *rest = CUT.split(text)
            out.append(sum(lengths([first, *[" " + x for x in rest]])))
    for x in fresh:
        if len(x) > MEMO_CHARS:
            del memo[x]
    return out


def _encode(path: str, version: str):
    def run(batches):
        for batch in batches:
            texts, digests = batch.column("text"), batch.column("digest")
            for at, length in slices(texts, 1 << 20):
                part = texts.slice(at, length).to_pylist()
                yield pa.RecordBatch.from_arrays([digests.slice(at, length), pa.array(count_tokens(part, path, version), pa.int64())], ["digest", "n_tokens"])

    return run


def count(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row; the cache at cache_path grows by the misses."""
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), content.alias("text"), F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    schema = "digest string, n_tokens long, version string"
    stored, hits = _read_cache(spark, cache_path, schema), None
    if stored is not None:
        digests = materialize(rows.select("digest").distinct(), "token-digests")
        n = digests.count()
        same = stored.filter(F.col("version") == version).select("digest", "n_tokens")
        hits = materialize(join_small(same, digests, ["digest"], "left_semi", n).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-hits")
        n_hits = hits.count()
    counts = hits
    if hits is None or n_hits < n:
        distinct = rows.groupBy("digest").agg(F.first("text").alias("text"))
        if hits is not None and n - n_hits <= BROADCAST_ROWS:  # few misses: their texts alone are shuffled
            missing = digests.join(hits.select("digest").hint("merge"), "digest", "left_anti")
            distinct = rows.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        elif hits is not None:  # one row a digest by now, so no hot one is left to a join
            distinct = distinct.join(hits.select("digest").hint("merge"), "digest", "left_anti")
        fresh = distinct.mapInArrow(_encode(tokenizer_path, version), "digest string, n_tokens long")
        run = f"{cache_path.rstrip('/')}/run=r{uuid.uuid4().hex}"
        with cleanup(spark):
            fresh.withColumn("version", F.lit(version)).write.parquet(run)
        made = spark.read.schema(schema).parquet(run).select("digest", "n_tokens")
        counts = made if hits is None else hits.unionByName(made)
    return rows.select(key, "n_bytes", "digest").join(counts.hint("merge"), "digest").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def compact(spark, cache_path: str) -> None:
    """Join a cache's folders into one without repeated digests. No run may use it meanwhile: readers
    of the old folders would miss them."""
    stored = _read_cache(spark, cache_path, "digest string, n_tokens long, version string")
    if stored is None:
        return
    old = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
    stored.groupBy("digest", "version").agg(F.max("n_tokens").alias("n_tokens")).select("digest", "n_tokens", "version").write.parquet(f"{cache_path.rstrip('/')}/run=r{uuid.uuid4().hex}")
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in old:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def _read_cache(spark, path: str, schema: str):
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(schema).parquet(path) if where.getFileSystem(hadoop).exists(where) else None
