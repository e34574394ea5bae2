"""A Merkle manifest of a dataset: a tree over each group's rows, and one over the groups.

A row's leaf is the sha256 of its fields, each `-` if null, else its UTF-8 byte count, a colon and
the value. Within a group leaves are ordered by key; `fanout` consecutive nodes become the sha256 of
their digests (hex text, concatenated), the last run of a level may be shorter, down to one node,
until one remains: the group's subroot. The subroots, ordered by group, give the root likewise.

Leaves are placed by one range partition on (group, key), so a group of any size spreads over
tasks: each task numbers its own rows, and the sums of the counts before it are added. A power of
the fanout of consecutive places is a block, and a block is one contiguous numpy matrix of 64-byte
digests: reshaped by the fanout, its rows are hashed level by level. The blocks' roots are the next
round's nodes, so after a few rounds, each smaller by the size of a block, every group has one node.
Proofs go the other way: a block gets the siblings above its root, index arithmetic gives those
inside, and no row meets more than its own block. A proof holds siblings only; on which side they
stand follows from the place and the number of leaves.

Placed leaves are written to the shared folder before they are used, so a task that runs again
finds the same places.

Defined results: a null key comes first, rows of one key are ordered by leaf, equal rows have
neighbouring places and proofs of their own; a null group is a group of its own, before all others
(an empty one is another), groups are ordered by their UTF-8 bytes; null fields and empty texts
have different leaves; texts of any length are hashed by Spark, only digests reach Python; an empty table gives an
empty result; the manifest's own columns replace those of the same name, others do not enter it.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize

HEX = 64
#: Nodes of a block: the largest power of the fanout up to this.
BLOCK = 1024
PROOF = "place long, places long, group_place long, groups long, siblings string, subroot string, root string"


def block_of(fanout: int) -> tuple[int, int]:
    """The number of a block's levels and of its nodes."""
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    return depth, fanout**depth


def leaf(fields: list[F.Column]) -> F.Column:
    """The digest of a row's fields, in this order."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


# ---------------------------------------------------------------- blocks


def matrix_of(digests: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(digests.cast(pa.binary()).to_pylist()), np.uint8).reshape(-1, HEX)


def hash_level(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The digests of each `fanout` consecutive rows of a matrix; the last run may be shorter."""
    whole = len(nodes) // fanout * fanout
    made = [sha256(row).hexdigest() for row in np.ascontiguousarray(nodes[:whole]).reshape(-1, fanout * HEX)]
    if whole < len(nodes):
        made.append(sha256(np.ascontiguousarray(nodes[whole:])).hexdigest())
    return np.frombuffer("".join(made).encode(), np.uint8).reshape(-1, HEX)


def block_levels(nodes: np.ndarray, places: int, fanout: int, depth: int) -> list[np.ndarray]:
    """A block's levels, its nodes first and its root last. Where its group has more blocks (places
    counts the group's nodes), a short block climbs as high as the others."""
    levels = [nodes]
    while len(levels) <= depth if places > fanout**depth else len(levels[-1]) > 1:
        levels.append(hash_level(levels[-1], fanout))
    return levels


def block_siblings(levels: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each node of a block the digests of its siblings up to the block's root, left to right."""
    at = np.arange(len(levels[0]))
    found, there = [], []
    for level in levels[:-1]:
        first = at - at % fanout
        for k in range(fanout):
            # the run's k-th place, or none if that is the node itself or past the end
            other = first + k
            there.append((other != at) & (other < len(level)))
            found.append(level[np.where(there[-1], other, 0)])
        at = at // fanout
    if not found:
        return [b""] * len(levels[0])
    digests, mask = np.stack(found, 1), np.stack(there, 1)
    return [own[has].tobytes() for own, has in zip(digests, mask, strict=True)]


def _roots(fanout: int):
    depth, size = block_of(fanout)

    def run(key, nodes):
        nodes = nodes.sort_by("place")
        places = nodes["places"][0].as_py()
        root = block_levels(matrix_of(nodes["digest"]), places, fanout, depth)[-1]
        return pa.table({"grp": [key[0].as_py()], "place": [key[1].as_py()], "places": [-(-places // size)], "digest": [root.tobytes().decode()]})

    return run


def _proofs(fanout: int, names: list[str]):
    """Of a block's nodes, from what stands above its root."""
    depth = block_of(fanout)[0]

    def run(key, nodes, above):
        nodes = nodes.sort_by("place")
        own = block_siblings(block_levels(matrix_of(nodes["digest"]), nodes["places"][0].as_py(), fanout, depth), fanout)
        upper = above["siblings"][0].as_py()
        made = {"siblings": pa.array([x.decode() + upper for x in own], pa.string())}
        shared = lambda n: pa.array([above[n][0].as_py()] * len(nodes), above.schema.field(n).type)
        return pa.table({n: made[n] if n in made else nodes[n] if n in nodes.column_names else shared(n) for n in names})

    return run


# ---------------------------------------------------------------- places


def _number(names: list[str]):
    """Rows sorted by grp: a running number within the task and grp."""

    def run(batches):
        last, count = None, 0
        for batch in batches:
            groups = batch.column("grp").to_numpy(zero_copy_only=False)
            if not len(groups):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            lengths = np.diff([*cuts, len(groups)])
            starts = np.zeros(len(cuts), np.int64)
            starts[0] = count if groups[0] == last else 0
            n = np.arange(len(groups)) - np.repeat(cuts - starts, lengths)
            last, count = groups[-1], int(n[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(n) if x == "n" else batch.column(x) for x in names], names)

    return run


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(grp, ...) with place, in its group by the order of `by`, and places, the group's count."""
    # equal rows may be many: a number of their own lets them spread over tasks
    rows = materialize(rows, "merkle-rows").withColumn("tie", F.monotonically_increasing_id())
    order = ["grp", *by, "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("task", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    numbered = materialize(dealt.mapInArrow(_number([*dealt.columns, "n"]), f"{kinds}, n long"), "merkle-numbered")
    counts = materialize(numbered.groupBy("grp", "task").agg(F.count("*").alias("own")), "merkle-counts")
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("own").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select("grp", "task", before.alias("before"), F.sum("own").over(whole).alias("places"))
    out = join_small(numbered, sums, ["grp", "task"], "inner", counts.count())
    return out.withColumn("place", F.col("before") + F.col("n")).drop("before", "n", "task")


def climb(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """Rounds of nodes(grp, place, places, digest), from those given to one node a group."""
    size = block_of(fanout)[1]
    rounds = [nodes]
    while (rounds[-1].agg(F.max("places")).first()[0] or 1) > 1:
        level = rounds[-1].select("grp", "place", "places", "digest")
        blocks = level.filter("places > 1").groupBy("grp", F.floor(F.col("place") / size).alias("block"))
        made = blocks.applyInArrow(_roots(fanout), "grp string, place long, places long, digest string")
        rounds.append(materialize(made.unionByName(level.filter("places = 1")), "merkle-round"))
    return rounds


def descend(rounds: list[DataFrame], crown: DataFrame, fanout: int) -> DataFrame:
    """The first round's nodes with all siblings; crown: one row a group, what stands above its last node."""
    size = block_of(fanout)[1]
    above = crown.withColumn("place", F.lit(0).cast("long"))
    for k, level in reversed(list(enumerate(rounds[:-1]))):
        own = [f for f in level.schema.fields if k == 0 or f.name in ("grp", "place")]
        fields = own + [f for f in above.schema.fields if f.name not in {x.name for x in own}]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        blocks = level.groupBy("grp", F.floor(F.col("place") / size).alias("block"))
        above = blocks.cogroup(above.groupBy("grp", "place")).applyInArrow(_proofs(fanout, [f.name for f in fields]), kinds)
        if k:
            above = materialize(above, "merkle-proofs")
    if len(rounds) == 1:
        return rounds[0].join(above.drop("place"), "grp")
    return above


# ---------------------------------------------------------------- interface


def prove(rows: DataFrame, group: str = "lang", key: str = "doc_id", digest: str = "leaf", fanout: int = 2) -> DataFrame:
    """rows with the columns of PROOF: place and places in the group, group_place and groups, the
    siblings up to the root as concatenated hex digests, subroot and root."""
    if fanout < 2:
        raise ValueError("a fanout of at least 2 is needed")
    rows = rows.drop(*[c.split()[0] for c in PROOF.split(", ")], "grp", "digest")
    # a null group sorts first and is no empty one
    keyed = rows.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))).withColumn("digest", F.col(digest))
    rounds = climb(placed(keyed, [key, "digest"]), fanout)
    tops = rounds[-1].select("grp", "digest")
    heads = placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("owner"), "digest"), ["owner"])
    upper = climb(heads, fanout)
    root = upper[-1].select(F.col("digest").alias("root"))
    empty = root.select(F.lit("").alias("grp"), F.lit("").alias("siblings"), "root")
    crown = descend(upper, empty, fanout)
    crown = crown.select(F.col("owner").alias("grp"), "siblings", "root", F.col("digest").alias("subroot"), F.col("place").alias("group_place"), F.col("places").alias("groups"))
    return descend(rounds, materialize(crown, "merkle-crown"), fanout).drop("grp", "digest")


def fold(digest: bytes, place: int, places: int, siblings: bytes, fanout: int) -> tuple[bytes, bytes]:
    """The digest at the top of a tree of `places` leaves, and the siblings that it has not used."""
    while places > 1:
        first = place - place % fanout
        left, all_ = HEX * (place - first), HEX * (min(fanout, places - first) - 1)
        digest = sha256(siblings[:left] + digest + siblings[left:all_]).hexdigest().encode()
        siblings, place, places = siblings[all_:], place // fanout, -(-places // fanout)
    return digest, siblings


def fold_proof(digest: str, place: int, places: int, group_place: int, groups: int, siblings: str, fanout: int = 2) -> str | None:
    """The root that a leaf and its proof lead to; None if the proof is too long or too short."""
    top, rest = fold(digest.encode(), place, places, siblings.encode(), fanout)
    root, rest = fold(top, group_place, groups, rest, fanout)
    used = sum(_siblings(p, n, fanout) for p, n in ((place, places), (group_place, groups)))
    return root.decode() if not rest and len(siblings) == HEX * used else None


def _siblings(place: int, places: int, fanout: int) -> int:
    n = 0
    while places > 1:
        n += min(fanout, places - (place - place % fanout)) - 1
        place, places = place // fanout, -(-places // fanout)
    return n


def _fold(names: list[str], digest: str, fanout: int):
    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (digest, "place", "places", "group_place", "groups", "siblings")]
            roots = pa.array([fold_proof(*row, fanout) for row in zip(*columns, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([roots if n == "folded_root" else batch.column(n) for n in names], names)

    return run


def verify(proofs: DataFrame, digest: str = "leaf", fanout: int = 2) -> DataFrame:
    """proofs with folded_root, recomputed from the leaf in column `digest` and the siblings, and verified."""
    proofs = proofs.drop("folded_root", "verified")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema.fields)
    out = proofs.mapInArrow(_fold([*proofs.columns, "folded_root"], digest, fanout), f"{kinds}, folded_root string")
    return out.withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and presented: the leaf of the row as it is shown, which in every seventh
    row by crc32 of its id has 1 added to n_chars."""
    fields = [F.col(c) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    presented = F.when(tampered, leaf([more if c == "n_chars" else F.col(c) for c in FIELDS]))
    return docs.select("doc_id", "lang", leaf(fields).alias("leaf"), presented.alias("presented"))


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of a table of documents, with each proof held against what is presented."""
    proofs = prove(document_leaves(docs)).withColumn("presented", F.coalesce("presented", "leaf"))
    return verify(proofs, "presented").select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


ORACLE = r"""
WITH RECURSIVE b AS (
  SELECT doc_id, lang, source, text, n_chars, n_chars + CASE WHEN doc_id IS NOT NULL AND
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 7 = 0 THEN 1 ELSE 0 END AS shown
  FROM documents
), a AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, leaf, shown FROM (
    SELECT b.doc_id, coalesce('=' || b.lang, '') AS g,
      sha256(d || s || l || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || t) AS leaf,
      sha256(d || s || l || coalesce(strlen(CAST(shown AS VARCHAR)) || ':' || shown, '-') || t) AS shown
    FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS d, coalesce(strlen(source) || ':' || source, '-') AS s,
      coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(text) || ':' || text, '-') AS t FROM b) b) x
), n AS (
  SELECT 0 AS h, g, i, leaf AS d, count(*) OVER (PARTITION BY g) AS m FROM a
  UNION ALL
  SELECT h + 1, g, i // 2, sha256(string_agg(d, '' ORDER BY i)), (max(m) + 1) // 2 FROM n WHERE m > 1 GROUP BY h, g, i // 2
), c AS (
  SELECT g, h AS top, d AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i FROM n WHERE m = 1
), u AS (
  SELECT 0 AS h, i, subroot AS d, count(*) OVER () AS m FROM c
  UNION ALL
  SELECT h + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (max(m) + 1) // 2 FROM u WHERE m > 1 GROUP BY h, i // 2
), e AS (
  SELECT h AS top, d AS root FROM u WHERE m = 1
), s AS (
  SELECT a.doc_id, a.shown, c.g, c.top, e.top AS top2, a.i AS i1, c.i AS i2, subroot, root, leaf FROM a JOIN c USING (g), e
), w AS (
  SELECT s.doc_id, h, CASE WHEN h < top THEN i1 >> h ELSE i2 >> (h - top) END AS pos, s.g, top FROM s, range(s.top + s.top2) r(h)
), x AS (
  SELECT w.doc_id, w.h, w.pos, coalesce(v.d, '') AS d FROM w
  LEFT JOIN n v ON v.g = w.g AND v.h = w.h AND v.i = xor(w.pos, 1) WHERE w.h < w.top
  UNION ALL
  SELECT w.doc_id, w.h, w.pos, coalesce(u.d, '') FROM w LEFT JOIN u ON u.h = w.h - w.top AND u.i = xor(w.pos, 1) WHERE w.h >= w.top
), y AS (
  SELECT doc_id, sha256(string_agg(d, '' ORDER BY h)) AS proof_sha256, list(d ORDER BY h) AS ds, list(pos & 1 ORDER BY h) AS sides FROM x GROUP BY doc_id
), z AS (
  SELECT doc_id, 0 AS h, shown AS d FROM s
  UNION ALL
  SELECT z.doc_id, h + 1, sha256(CASE WHEN sides[h + 1] = 1 THEN ds[h + 1] || d ELSE d || ds[h + 1] END) FROM z JOIN y USING (doc_id) WHERE h < len(ds)
)
SELECT s.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, z.d AS folded_root, z.d = root AS verified
FROM s LEFT JOIN y USING (doc_id) JOIN z ON z.doc_id = s.doc_id AND z.h = s.top + s.top2
"""
