"""URL verdicts by host and path rules, and gradient-boosted trees elsewhere. DataFrame operations only.

Training is by histograms: the labelled URLs (a bounded sample, TRAIN_ROWS of each label by hash,
each label weighted to its number among all labelled URLs) become bins of lexical features, equal
rows are merged with their weights, and each level of each tree is one aggregation of gradients by
node, feature and bin; the driver sees those sums alone and picks the splits. A fitted model is a sum of CASE expressions, so scoring is a projection of
the pages with no shuffle.

Features: lengths of url, host and path, depth, digit ratio, host entropy, hyphens and labels of
the host, query parameters, and of the host's suffix (its last two labels) the count and smoothed
label mean among all labelled urls. Up to SUFFIX_ROWS suffixes are part of the model's expression;
more are a table that the pages are joined with.

Defined results: a null url or one without ``://`` has an empty host and path and is judged by the
model; rows are independent, so repeated rows agree; an empty table gives an empty result; without
labels of both kinds every url without a rule is allowed; of rules that fit a url, the longest wins, and no two
of one length fit; urls of any length are measured whole; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 10, 2, 12, 0.4, 1.0, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url) -> tuple[F.Column, F.Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)


def rule_of(host, path, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_of(host) -> F.Column:
    return F.substring_index(host, ".", -2)


def features(url, host, path) -> dict[str, F.Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.length(host)
    share = lambda c: (size - F.length(F.replace(host, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(host, "")), F.lit(0.0), lambda s, c: s - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    return {
        "url_length": number(F.length(text)),
        "host_length": number(size),
        "path_length": number(F.length(path)),
        "depth": number(F.regexp_count(path, F.lit("/[^/]"))),
        "digit_ratio": number(F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.lit(1), F.length(text))),
        "host_entropy": F.when(size > 0, entropy).otherwise(0.0),
        "host_hyphens": number(F.regexp_count(host, F.lit("-"))),
        "host_labels": number(F.regexp_count(host, F.lit(r"[^.]+"))),
        "parameters": number(F.regexp_count(text, F.lit(r"[?&][^=&#]+="))),
    }


@dataclass
class Boosted:
    """base + sum of trees; a tree is (feature, edge, left, right) with numbers as leaves."""

    base: float = -20.0
    trees: list = field(default_factory=list)
    suffixes: dict[str, tuple[float, float]] = field(default_factory=dict)
    suffix_table: DataFrame | None = None  # in place of a dict that would be too long
    suffix_rows: int = 0
    overall: float = 0.0

    def margin(self, cols: dict[str, F.Column]) -> F.Column:
        def walk(node) -> F.Column:
            if isinstance(node, float):
                return F.lit(node)
            name, edge, left, right = node
            return F.when(cols[name] <= edge, walk(left)).otherwise(walk(right))

        return reduce(lambda a, t: a + walk(t), self.trees, F.lit(self.base))

    def suffix_features(self, host) -> dict[str, F.Column]:
        if not self.suffixes:
            return {"suffix_count": F.lit(0.0), "suffix_mean": F.lit(0.0)}
        table = F.create_map(*[x for s, (n, m) in self.suffixes.items() for x in (F.lit(s), F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")))])
        found = F.try_element_at(table, suffix_of(host))
        overall = sum(n * m for n, m in self.suffixes.values()) / sum(n for n, _ in self.suffixes.values())
        return {"suffix_count": F.coalesce(found["n"], F.lit(0.0)), "suffix_mean": F.coalesce(found["m"], F.lit(overall))}


    def with_suffixes(self, rows: DataFrame) -> DataFrame:
        """rows(host) with suffix_count and suffix_mean; a suffix without labels has the mean of all."""
        if self.suffix_table is None:
            return rows.withColumns(self.suffix_features(F.col("host")))
        joined = join_small(rows.withColumn("_suffix", suffix_of(F.col("host"))), self.suffix_table, ["_suffix"], "left", self.suffix_rows).drop("_suffix")
        return joined.withColumns({"suffix_count": F.coalesce("suffix_count", F.lit(0.0)), "suffix_mean": F.coalesce("suffix_mean", F.lit(self.overall))})


#: Suffixes that a model holds as an expression; more are joined as a table.
SUFFIX_ROWS = 1000


def document_of(url) -> F.Column:
    """The number of the document that a page serves: the last of its path, or null."""
    return F.regexp_extract(url_parts(url)[1], "([0-9]{1,18})(?:[.][a-z]+)?/?$", 1).try_cast("long")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url, label of the pages whose document is labelled: 1 if it is toxic or of bad quality, else 0.

    labels(doc_id, quality, toxic); a document of several rows is bad if one says so, and rows
    without either label say nothing."""
    bad = (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).cast("int")
    known = labels.filter("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy(F.col("doc_id").alias("doc")).agg(F.max(bad).alias("label"))
    return pages.select("url", document_of(F.col("url")).alias("doc")).join(known.hint("merge"), "doc").select("url", "label")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    pick = lambda k: labelled.filter(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(TRAIN_ROWS)
    host, path = url_parts(F.col("url"))
    own = features(F.col("url"), host, path)
    rows = materialize(pick(0).unionByName(pick(1)).select("label", host.alias("host"), *[c.alias(n) for n, c in own.items()]), "url-sample")
    model = Boosted()
    every = labelled.filter(F.col("label").isin(0, 1)).groupBy(suffix_of(host).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    every = materialize(every, "url-suffixes")
    n_suffixes, total, hits = every.agg(F.count("*"), F.sum("n"), F.sum("y")).first()
    if not 0 < (hits or 0) < (total or 0):
        return model
    if n_suffixes <= SUFFIX_ROWS:
        model.suffixes = {r.s: (float(r.n), (r.y + 10 * hits / total) / (r.n + 10)) for r in every.orderBy(F.desc("n"), "s").collect()}
    else:
        mean = (F.col("y") + 10 * hits / total) / (F.col("n") + 10)
        model.suffix_table = every.select(F.col("s").alias("_suffix"), F.col("n").cast("double").alias("suffix_count"), mean.alias("suffix_mean"))
        model.suffix_rows = n_suffixes
        model.overall = model.suffix_table.agg(F.sum(F.col("suffix_count") * F.col("suffix_mean")) / total).first()[0]
    # a label of which the sample has a part only counts as often as among all labelled urls
    sampled, sampled_hits = rows.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1, hits / max(1, sampled_hits)).otherwise((total - hits) / max(1, sampled - sampled_hits))
    names = [*own, "suffix_count", "suffix_mean"]
    rows = model.with_suffixes(rows)
    cuts = rows.agg(*[F.percentile_approx(n, [k / BINS for k in range(1, BINS)], 1000).alias(n) for n in names]).first()
    edges = {n: sorted(set(cuts[n])) for n in names}
    # rows of equal bins are one row with counts
    binned = {n: reduce(lambda a, e, n=n: a + (F.col(n) > e).cast("int"), edges[n], F.lit(0)) for n in names}
    rows = materialize(rows.groupBy(*[binned[n].alias(n) for n in names]).agg(F.sum(weight).alias("n"), F.sum(weight * F.col("label")).alias("y")), "url-bins")
    bins = {n: F.col(n) for n in names}
    model.base = math.log(hits / (total - hits))
    inner = Boosted(model.base)  # the same trees, over bins
    for _ in range(trees):
        p = 1 / (1 + F.exp(-inner.margin(bins)))
        graded = rows.select(*names, (p * F.col("n") - F.col("y")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
        tree: dict[int, tuple[str, int]] = {}
        sums: dict[int, tuple[float, float]] = {}
        for level in range(depth):
            node = F.lit(1)
            for k in sorted(tree):
                name, at = tree[k]
                node = F.when(node == k, F.lit(2 * k) + (bins[name] > at).cast("int")).otherwise(node)
            cells = graded.select(node.alias("node"), "g", "h", F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("bin")) for i, n in enumerate(names)])).alias("c"))
            found = cells.groupBy("node", "c.f", "c.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for k in range(1 << level, 2 << level):
                best = _best_split([r for r in found if r.node == k], len(names))
                if k == 1 or k // 2 in tree:
                    sums[k] = (sum(r.g for r in found if r.node == k and r.f == 0), sum(r.h for r in found if r.node == k and r.f == 0))
                if best:
                    _, f, at, left, right = best
                    tree[k] = (names[f], at)
                    sums[2 * k], sums[2 * k + 1] = left, right

        def build(k, over):
            if k not in tree:
                g, h = sums[k]
                return float(-RATE * g / (h + RIDGE))
            name, at = tree[k]
            return (name, over[name][at] if over else at, build(2 * k, over), build(2 * k + 1, over))  # noqa: B023

        if not tree:
            break
        inner.trees.append(build(1, None))
        model.trees.append(build(1, edges))
    return model


def _best_split(rows, n_features: int):
    """Greatest gain (gain, feature, last bin on the left, left sums, right sums), or None."""
    best = None
    for f in range(n_features):
        own = sorted((r.bin, r.g, r.h) for r in rows if r.f == f)
        g, h = sum(x[1] for x in own), sum(x[2] for x in own)
        gl = hl = 0.0
        for at, dg, dh in own[:-1]:
            gl, hl = gl + dg, hl + dh
            if min(hl, h - hl) < LEAST_HESSIAN / 10:
                continue
            gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, at, (gl, hl), (g - gl, h - hl))
    return best


def judge(pages: DataFrame, model: Boosted, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    cols = features(F.col("url"), F.col("host"), F.col("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = model.with_suffixes(rows.withColumns(cols))
    score = 1 / (1 + F.exp(-model.margin({n: F.col(n) for n in (*cols, "suffix_count", "suffix_mean")})))
    own = F.when(score >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), score.alias("score"))
