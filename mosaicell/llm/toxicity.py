"""Toxicity: a convolutional text classifier in numpy.

A word is the mean of hashed embeddings of itself, its prefixes and its last letters. Filters of
several widths run over the words, each is pooled by its maximum over the whole text, and a
logistic layer makes the score. One dimension of the embeddings starts from how much a bucket's
presence tells the training rows' labels apart (the signed root of its likelihood ratio), so that
the maxima point at telling words from the first step.

`learn` uses every labelled row outside the held-out fold, of any length. Four fifths train, dealt to parts of about PART_ROWS
rows or PART_BYTES of text by a hash of the doc_id; a part's words are numbered once and stored. A task counts presences
or runs Adam over one part, from the model of the round before, and the parts' models are averaged by slices, ROUNDS times. One part alone gets EPOCHS in one round.
The last fifth sets thresholds: for each language, as guessed from the text's own stop words, the one with the
best F1 (logits are counted to 1 / GRID) is moved to CUT. A language with few toxic rows uses the threshold of all.
Of rows only these counts and of models only their mean reach the driver; both have fixed sizes.

Neither labels nor the columns lang, source and doc_id enter a score. Scoring is one pass over the
documents; a filter's response is a sum of rows of a table of projected words, so long texts cost
time in proportion and memory by batch.

Defined results: null texts and texts without words get the score of an empty text; null doc_ids
count as the empty string for the fold; labels of unknown documents and null labels are ignored;
repeated rows each get a row; an empty table gives an empty result; without labels of both kinds
the score is the constant 0; a text of any length is scored whole, and equal texts have equal scores. Further columns are kept by `score` and `keep_clean`; `score` replaces
a column of its result's name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, remove, slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 8, (1, 2, 3)
PREFIXES, SUFFIX = (3, 4, 5, 6, 7), 3
#: The UTF-8 size of a text of `training_rows`, at most.
TRAIN_BYTES = 30_000
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Rows and UTF-8 bytes of a part that a task learns from, about; rounds of several parts, rows and words of their steps, at most.
PART_ROWS, PART_BYTES, ROUNDS, PART_BATCH, BATCH_WORDS = 2048, 16 << 20, 3, 32, 200_000
#: Tasks that number the words of parts, at most; values of a slice of a model; steps of a logit that thresholds tell apart.
PART_TASKS, SLICE, GRID = 1024, 4096, 1024
CUT = 0.7
MEMO_WORDS = 250_000
WORD = re.compile(r"\w+")
#: Frequent function words by language.
STOPWORDS = {
    "en": "the and of to in is that it for was on with as by this be are from".split(),
    "fr": "le la les de des du et un une que qui pour dans est par sur au avec".split(),
    "de": "der die das und ist von zu den mit dem nicht ein eine für auf im des".split(),
    "es": "el los las de del y que en un una por con para se es al como su".split(),
}
LANGS = (*STOPWORDS, "other")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(word: str) -> list[int]:
    """Bucket ids from 1; 0 stands for none."""
    parts = [f"={word}", *(f"^{word[:k]}" for k in PREFIXES if len(word) >= k), f"{word[-SUFFIX:]}$"]
    ids = [1 + xxhash.xxh32_intdigest(p) % (BUCKETS - 1) for p in parts]
    return ids + [0] * (2 + len(PREFIXES) - len(ids))


def guess_language(words: list[str], lookup: dict[str, list[int]]) -> int:
    votes = [0] * len(STOPWORDS)
    for w in words:
        for k in lookup.get(w, ()):
            votes[k] += 1
    best = max(votes)
    return votes.index(best) if best else len(STOPWORDS)


def _lookup() -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, own in enumerate(STOPWORDS.values()):
        for w in own:
            out.setdefault(w, []).append(k)
    return out


# ---------------------------------------------------------------- model


@dataclass
class Model:
    emb: np.ndarray
    taps: np.ndarray  # DIM x (one block of FILTERS for each position of each width)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGS), np.float32))
    constant: bool = False

    @classmethod
    def fresh(cls, seed: int = 0, evidence: np.ndarray | None = None) -> Model:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        taps = rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
        if evidence is not None:
            emb[:, 0] = evidence
            taps[0] = np.abs(taps[0]) + 0.5
        emb[0] = 0
        return cls(emb, taps, np.zeros(FILTERS * len(WIDTHS), np.float32), np.abs(rng.normal(0, 0.1, FILTERS * len(WIDTHS))).astype(np.float32), 0.0)

    def project(self, feats: np.ndarray) -> np.ndarray:
        return self.vectors(feats) @ self.taps

    def vectors(self, feats: np.ndarray) -> np.ndarray:
        return self.emb[feats].sum(1) / np.maximum(1, (feats > 0).sum(1))[:, None]

    def responses(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The filters at each place of a run of words; places past the run's end see pads (id 0)."""
        ids = np.concatenate([ids, np.zeros(max(WIDTHS), ids.dtype)])
        n, out, block = len(ids) - max(WIDTHS), [], 0
        for width in WIDTHS:
            r = None
            for k in range(width):
                own = table[ids[k : n + k], block * FILTERS : (block + 1) * FILTERS]
                r = own if r is None else r + own
                block += 1
            out.append(r)
        return np.concatenate(out, 1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def _padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words in one run, each document followed by pads; where the documents start and end.

    A document's places are its words and one pad, so that an empty one has a place; the other pads
    keep the filters from seeing the next document."""
    pads = np.zeros(max(WIDTHS), np.int32)
    flat = np.concatenate([x for d in docs for x in (d, pads)]) if docs else pads
    starts = np.cumsum([0, *(len(d) + len(pads) for d in docs)])[:-1]
    return flat, starts, starts + np.array([len(d) + 1 for d in docs], np.int64)


def _pooled(responses: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each document, the greatest response of each filter over its places."""
    return np.maximum.reduceat(responses, np.stack([starts, ends], 1).ravel(), 0)[::2]


def train(docs: list[np.ndarray], feats: np.ndarray, labels: np.ndarray, seed: int = 0) -> Model:
    """docs: word ids of each text, feats: buckets of each word (row 0: the pad)."""
    model = Model.fresh(seed, evidence(*presences(docs, feats, labels)))
    descend(model, docs, feats, labels, (len(labels) - labels.sum(), labels.sum()), _epochs(len(docs)), BATCH, np.random.default_rng(seed))
    return model


def _epochs(rows: int) -> int:
    return EPOCHS if rows > 1000 else 4 * EPOCHS


def _steps(docs: list[np.ndarray], order: np.ndarray, batch: int):
    """Runs of the order of at most so many documents, and of BATCH_WORDS words or one document."""
    pick, words = [], 0
    for i in order.tolist():
        if pick and (len(pick) == batch or words + len(docs[i]) > BATCH_WORDS):
            yield np.array(pick)
            pick, words = [], 0
        pick.append(i)
        words += len(docs[i])
    if pick:
        yield np.array(pick)


def descend(model: Model, docs: list[np.ndarray], feats: np.ndarray, labels: np.ndarray, totals: tuple, epochs: int, batch: int, rng) -> None:
    """Adam over the documents, in place. totals: how many rows of label 0 and 1 there are in all, whose weights they set."""
    weight = np.where(labels == 1, sum(totals) / (2 * max(1, totals[1])), sum(totals) / (2 * max(1, totals[0]))).astype(np.float32)
    params = {"emb": model.emb, "taps": model.taps, "bias": model.bias, "out": model.out}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    slots = [(w, k) for w in range(len(WIDTHS)) for k in range(WIDTHS[w])]
    step = 0
    for _ in range(epochs):
        for pick in _steps(docs, rng.permutation(len(docs)), batch):
            flat, starts, ends = _padded([docs[i] for i in pick])
            words, ids = np.unique(flat, return_inverse=True)
            own = feats[words]
            vec = model.vectors(own)
            resp = model.responses(vec @ model.taps, ids)
            pooled = _pooled(resp, starts, ends)
            place = np.stack([a + resp[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])
            hidden = pooled + model.bias
            live = hidden > 0
            logit = np.where(live, hidden, 0) @ model.out + model.out_bias
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) * weight[pick] / len(pick)
            g_out = np.where(live, hidden, 0).T @ error
            g_hidden = np.where(live, error[:, None] * model.out, 0)
            # the gradient reaches the words under each filter's maximum only
            g_table = np.zeros((len(words), model.taps.shape[1]), np.float32)
            tail = np.concatenate([ids, np.zeros(max(WIDTHS), ids.dtype)])
            for block, (w, k) in enumerate(slots):
                cols = slice(w * FILTERS, (w + 1) * FILTERS)
                np.add.at(g_table, (tail[place[:, cols] + k], np.arange(block * FILTERS, (block + 1) * FILTERS)[None, :]), g_hidden[:, cols])
            hit = np.flatnonzero(np.abs(g_table).sum(1) > 0)
            g_vec = g_table[hit] @ model.taps.T
            g_feat = g_vec / np.maximum(1, (own[hit] > 0).sum(1))[:, None]
            rows, where = np.unique(own[hit], return_inverse=True)
            g_rows = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g_rows, where.reshape(own[hit].shape), g_feat[:, None, :])
            g_rows[rows == 0] = 0
            step += 1
            grads = {"taps": vec[hit].T @ g_table[hit], "bias": g_hidden.sum(0), "out": g_out}
            for k, g in grads.items():
                _adam(params[k], g, moments[k], step, slice(None))
            _adam(params["emb"], g_rows, moments["emb"], step, rows)
            model.out_bias -= RATE * float(error.sum())


def presences(docs: list[np.ndarray], feats: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By label, how many documents hold each bucket, and how many there are."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for words, y in zip(docs, labels.tolist(), strict=True):
        seen[y, np.unique(feats[np.unique(words)])] += 1
    return seen, np.bincount(labels, minlength=2)


def evidence(seen: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each bucket, the signed root of the likelihood ratio of its presence and the label."""
    n = np.maximum(1, rows).astype(float)[:, None]
    cells, ratio = [seen, n - seen], np.zeros(BUCKETS)
    for cell in cells:
        expected = n * cell.sum(0) / n.sum()
        ratio += np.where(cell > 0, cell * np.log(np.maximum(cell, 1e-9) / np.maximum(expected, 1e-9)), 0).sum(0)
    out = np.sign(seen[1] / n[1] - seen[0] / n[0]) * np.sqrt(np.maximum(0, 2 * ratio)) / 3
    out[0] = 0
    return out.astype(np.float32)


def _adam(p, g, moment, step, rows) -> None:
    m, v = moment
    m[rows] = 0.9 * m[rows] + 0.1 * g
    v[rows] = 0.999 * v[rows] + 0.001 * g * g
    p[rows] -= RATE * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.999**step)) + 1e-6)


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut with the best weighted F1, half way to the next logit."""
    order = np.argsort(-logits, kind="stable")
    x, y, w = logits[order], labels[order], weights[order]
    hit, wrong = np.cumsum(w * y), np.cumsum(w * (1 - y))
    f1 = 2 * hit / (hit + wrong + (w * y).sum())
    f1[:-1][x[:-1] == x[1:]] = -1  # equal logits fall on one side
    k = int(f1.argmax())
    return float((x[k] + x[k + 1]) / 2 if k + 1 < len(x) else x[k] - 1)


def tokenised(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word ids of each text, buckets of each word (row 0: the pad), and languages."""
    vocab: dict[str, int] = {}
    docs, langs, lookup = [], [], _lookup()
    for text in texts:
        words = words_of(text)
        langs.append(guess_language(words, lookup))
        docs.append(np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in words), np.int32, len(words)))
    return docs, np.array([[0] * (2 + len(PREFIXES)), *map(word_features, vocab)], np.int32), np.array(langs, int)


def fit(texts: list[str], labels: np.ndarray, negative_weight: float = 1.0, seed: int = 0) -> Model:
    """A model of texts at hand, without Spark; `learn` is for tables."""
    if len(set(labels.tolist())) < 2:
        return _constant()
    docs, feats, langs = tokenised(texts)
    tests = np.random.default_rng(seed).permutation(len(docs)) % 5 == 0
    model = train([d for d, t in zip(docs, tests, strict=True) if not t], feats, labels[~tests], seed)
    scores = np.concatenate([_score(model, model.project(feats), docs[at : at + 256]) for at in range(0, len(docs), 256)])
    use = tests if labels[tests].sum() >= 20 else np.ones(len(docs), bool)
    n = np.ones(use.sum())
    model.shift = thresholds(scores[use], labels[use], langs[use], n, np.where(labels[use] == 1, 1.0, negative_weight))
    return model


def thresholds(logits: np.ndarray, labels: np.ndarray, langs: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By language, the best cut of logits that occur n times."""
    shift = np.full(len(LANGS), best_threshold(logits, labels, n * weights), np.float32)
    for k in range(len(LANGS)):
        own = langs == k
        if (n * labels)[own].sum() >= 20 and (n * (1 - labels))[own].sum() >= 20:
            shift[k] = best_threshold(logits[own], labels[own], (n * weights)[own])
    return shift


def _constant() -> Model:
    model = Model.fresh()
    model.constant = True
    return model


def _score(model: Model, table: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    flat, starts, ends = _padded(docs)
    return model.logits(_pooled(model.responses(table, flat), starts, ends))


# ---------------------------------------------------------------- Spark


def training_rows(docs: DataFrame, labels: DataFrame, rows: dict[int, int]) -> tuple[list[str], np.ndarray, float]:
    """For trials with `fit`: so many rows by label, of at most TRAIN_BYTES each. Only the chosen labels are broadcast."""
    short = docs.filter((F.octet_length("text") <= TRAIN_BYTES) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    usable = materialize(known.join(short.hint("merge"), "doc_id", "left_semi"), "toxicity-labels")
    mix = lambda k: usable.filter(F.col("toxic") == k).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(rows[k])
    chosen = mix(0).unionByName(mix(1))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    found = sorted((r.doc_id, r.text, r.toxic) for r in texts.collect())
    y = np.array([f[2] for f in found], np.int64)
    ratio = (totals.get(0, 0) / max(1, totals.get(1, 0))) / max(1e-9, (y == 0).sum() / max(1, (y == 1).sum())) if len(y) else 1.0
    return [f[1] for f in found], y, max(1.0, float(ratio))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """key, text, toxic, fold (0 to 4) of every labelled document outside the held-out fold."""
    own = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    known = labels.filter(own & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = docs.filter(own).select("doc_id", "text").join(known.hint("merge"), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    key = F.xxhash64(F.lit("toxicity"), "doc_id")
    return found.select(key.alias("key"), "text", "toxic", F.pmod(key, F.lit(5)).cast("int").alias("fold"))


def _encoded(table: pa.Table) -> pa.Table:
    """Of one part's rows, in order of their keys, the words of each text as numbers, and their buckets."""
    table = table.sort_by([("key", "ascending")])
    docs, feats, _ = tokenised(table["text"].to_pylist())
    held = [table["toxic"].to_numpy().astype(np.int8), np.array([len(d) for d in docs], np.int64), np.concatenate([np.zeros(0, np.int32), *docs]), feats.astype(np.uint16)]
    return pa.Table.from_arrays([table["part"].slice(0, 1), *[pa.array([h.tobytes()], pa.large_binary()).cast(pa.binary()) for h in held]], ["part", "toxic", "lengths", "words", "feats"])


def _decoded(batches):
    """Parts as _encoded made them: part, words by document, buckets by word, labels."""
    for batch in batches:
        for part, toxic, lengths, words, feats in zip(*(batch.column(c) for c in ("part", "toxic", "lengths", "words", "feats")), strict=True):
            of = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
            docs = np.split(of(words, np.int32), np.cumsum(of(lengths, np.int64))[:-1])
            yield part.as_py(), docs, of(feats, np.uint16).reshape(-1, 2 + len(PREFIXES)).astype(np.int32), of(toxic, np.int8).astype(np.int64)


def _slice_batch(part: int, rows: int, values: np.ndarray) -> pa.RecordBatch:
    held = [values[at : at + SLICE].tobytes() for at in range(0, len(values), SLICE)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), part)), pa.array(np.arange(len(held)), pa.int32()), pa.array(np.full(len(held), rows)), pa.array(held, pa.binary())], SLICES)


def _counted(batches):
    """Presences in a task's parts, by slices."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for _, docs, feats, y in _decoded(batches):
        seen += presences(docs, feats, y)[0]
    yield _slice_batch(0, 1, seen.ravel())


SLICES = ["part", "slice", "rows", "held"]
SLICES_SCHEMA = "part long, slice int, rows long, held binary"


def _summed(kind: str, mean: bool):
    """Of one slice, the sum over all parts, or their mean by rows; in order of the parts, so that reruns agree."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("rows", "ascending")])
        rows, total = table["rows"].to_numpy(), 0
        for r, held in zip(rows.tolist(), table["held"], strict=True):
            total = total + np.frombuffer(held.as_buffer(), kind).astype(np.float64 if mean else np.int64) * (r if mean else 1)
        out = (total / rows.sum()).astype(kind) if mean else total
        return pa.Table.from_arrays([pa.array([0]), table["slice"].slice(0, 1), pa.array([int(rows.sum())]), pa.array([out.tobytes()], pa.binary())], SLICES)

    return run


def _whole(sliced: DataFrame, kind: str, mean: bool) -> np.ndarray:
    """One value for each of a model or of the presences, whatever the number of rows and parts."""
    found = sliced.groupBy("slice").applyInArrow(_summed(kind, mean), SLICES_SCHEMA).select("slice", "held").collect()
    return np.concatenate([np.frombuffer(r.held, kind) for r in sorted(found, key=lambda r: r.slice)])


def _packed(model: Model) -> np.ndarray:
    return np.concatenate([model.emb.ravel(), model.taps.ravel(), model.bias, model.out, [model.out_bias]]).astype(np.float32)


def _unpacked(values: np.ndarray) -> Model:
    model, at = Model.fresh(), 0
    for name in ("emb", "taps", "bias", "out"):
        own = getattr(model, name)
        setattr(model, name, values[at : at + own.size].reshape(own.shape).copy())
        at += own.size
    model.out_bias = float(values[at])
    return model


def _part_learner(start: np.ndarray, totals: tuple[int, int], seed: int, epochs: int, batch: int):
    def run(batches):
        for part, docs, feats, y in _decoded(batches):
            model = _unpacked(start)
            descend(model, docs, feats, y, totals, epochs, batch, np.random.default_rng([seed, part]))
            yield _slice_batch(part, len(docs), _packed(model))

    return run


def _placed(model: Model):
    """Counts of logits to 1 / GRID by label and language."""

    def run(batches):
        found: dict[tuple[int, int, int], int] = {}
        for batch, logits, langs in _logits(model, batches):
            at = np.clip(np.floor(logits.astype(float) * GRID), -30 * GRID, 30 * GRID).astype(int)
            for k in zip(at.tolist(), batch.column("toxic").to_pylist(), langs.tolist(), strict=True):
                found[k] = found.get(k, 0) + 1
        columns = zip(*((*k, n) for k, n in found.items()), strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "toxic", "lang", "n"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of all labelled rows outside the held-out fold."""
    rows = materialize(labelled(docs, labels), "toxicity-rows")
    found = rows.groupBy("toxic", (F.col("fold") == 0).alias("test")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).collect()
    n = {(r.toxic, r.test): r.n for r in found}
    totals = (n.get((0, False), 0), n.get((1, False), 0))
    if not all(n.get((y, True), 0) + totals[y] for y in (0, 1)):
        return _constant()
    parts = max(1, -(-sum(totals) // PART_ROWS), -(-sum(r.size for r in found if not r.test) // PART_BYTES))
    dealt = rows.filter("fold <> 0").select("key", "text", "toxic", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"))
    dealt = dealt.repartition(min(parts, PART_TASKS), "part").groupBy("part").applyInArrow(_encoded, "part long, toxic binary, lengths binary, words binary, feats binary")
    encoded = materialize(dealt, "toxicity-parts")
    seen = _whole(encoded.mapInArrow(_counted, SLICES_SCHEMA), "int64", False)
    model = Model.fresh(0, evidence(seen.reshape(2, BUCKETS), np.array(totals)))
    rounds, epochs, batch = (1, _epochs(sum(totals)), BATCH) if parts == 1 else (ROUNDS, 1, PART_BATCH)
    for k in range(rounds if sum(totals) else 0):
        model = _unpacked(_whole(encoded.mapInArrow(_part_learner(_packed(model), totals, k, epochs, batch), SLICES_SCHEMA), "float32", True))
    remove(docs.sparkSession, encoded)
    tests = rows.filter("fold = 0") if n.get((1, True), 0) >= 20 else rows
    counts = tests.select("text", "toxic").mapInArrow(_placed(model), "at long, toxic long, lang long, n long").groupBy("at", "toxic", "lang").agg(F.sum("n").alias("n"))
    at, y, langs, times = (np.array(c) for c in zip(*sorted(map(tuple, counts.collect())), strict=True))
    remove(docs.sparkSession, rows)
    model.shift = thresholds((at + 0.5) / GRID, y, langs, times.astype(float), np.ones(len(at)))
    return model


#: UTF-8 bytes of text whose words are scored at a time: about 200,000 words, or one text.
SCORE_BYTES = 1 << 20


def _logits(model: Model, batches):
    """Each batch with the logits and languages of its texts."""
    lookup, vocab = _lookup(), {}
    table = np.zeros((MEMO_WORDS, model.taps.shape[1]), np.float32)
    for batch in batches:
        texts, logits, langs = batch.column("text"), [np.zeros(0, np.float32)], [np.zeros(0, int)]
        for at, length in slices(texts, SCORE_BYTES):
            lists = [words_of(t) for t in texts.slice(at, length).to_pylist()]
            fresh = [w for w in set().union(*lists) if w not in vocab]
            if len(vocab) + len(fresh) + 1 > len(table):
                vocab.clear()
                fresh = list(set().union(*lists))
                if len(fresh) + 1 > len(table):
                    table = np.zeros((2 * len(fresh) + 1, table.shape[1]), np.float32)
            if fresh:
                first = len(vocab) + 1
                table[first : first + len(fresh)] = model.project(np.array([word_features(w) for w in fresh], np.int32))
                vocab.update((w, first + k) for k, w in enumerate(fresh))
            logits.append(_score(model, table, [np.fromiter(map(vocab.__getitem__, ws), np.int32, len(ws)) for ws in lists]))
            langs.append(np.array([guess_language(ws, lookup) for ws in lists], int))
        yield batch, np.concatenate(logits), np.concatenate(langs)


def _scorer(model: Model, names: list[str], added: str):
    def run(batches):
        for batch, logits, langs in _logits(model, batches):
            z = logits - model.shift[langs] + np.log(CUT / (1 - CUT))
            found = np.zeros(len(z)) if model.constant else 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found)], [*names, added])

    return run


def score(docs: DataFrame, model: Model, added: str = "score") -> DataFrame:
    """docs with the added column (0 to 1)."""
    docs = docs.drop(added)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scorer(model, docs.columns, added), f"{kinds}, {added} double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is below CUT, with the columns of docs alone."""
    added = free_name(docs, "toxicity_score")
    return score(docs, learn(docs, labels), added).filter(F.col(added) < CUT).drop(added)
