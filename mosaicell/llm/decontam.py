"""Benchmark decontamination by templates.

Texts become templates: numbers, units after numbers and names (capitalised words within a
sentence) turn into typed placeholders, other words are lower-cased and lose outer punctuation.
Windows of W template tokens are hashed, once with names as words (so a text in another case still
matches) and once as placeholders, and joined by hash with the windows of the benchmark. A window
of placeholders needs at least W / 2 plain words; one with more numbers and units is hashed with
their values, so it meets verbatim copies. For each document, item and alignment the matched windows are
counted and the placeholders' values compared: an item's value must stand for one value of the
document throughout, so "Ann has 3 cats" matches "Bob has 7 cats" but not a text that fills the
same slot in two ways. A capitalised word that opens a text or sentence may be a name or not, so its
windows have a form with it as a name too, and an alignment is judged with and without those.

A document is contaminated by an item if half of the item's windows, or RUN tokens' worth, match
in one alignment with consistent slots; windows of placeholders may reach half of their own number
alone. Items of fewer than W tokens are one window of their own length. Those of fewer than MIN_ITEM
are too short to tell a leak within a text: they match texts that consist of the same tokens and nothing
else. Tokens of punctuation alone are no tokens.

If the benchmark's windows are at most BROADCAST_WINDOWS and BROADCAST_BYTES, their sorted hashes and
its vocabulary are broadcast to the tasks: only windows all of whose words the benchmark has are hashed,
and only matching ones leave the scan. Beyond that all windows of the documents are shuffled
to a join with the benchmark's.

Defined results: null and empty texts match nothing; null ids of documents or items stay null and
are grouped as one; copies and repeated rows are judged alike, and rows repeated with one doc_id
give one row an item; of alignments that match as many windows, the one with the fewest changed slots
is reported; texts of any length are windowed whole, a slice of texts or one text at a time; empty tables
give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import string
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, slices

W, MIN_ITEM, RUN = 8, 4, 13
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 32 << 20
MEMO_TOKENS = 500_000
PUNCTUATION = string.punctuation + "«»“”‘’„…–—¿¡"
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
GLUED = re.compile(r"(?<=\d)(?=[^\W\d_])")
#: Units that count as such after a number.
UNITS = frozenset(
    "% percent kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot inch inches yard yards l ml litre litres liter liters "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur degree degrees c f mph kmh kwh w kw v a hz mb gb".split()
)
_NUM, _UNIT, _CAPITAL, _END, _EMPTY, _GLUED, _STRANGE = 1, 2, 4, 8, 16, 32, 64
_PLACES = {k: np.uint64(xxhash.xxh3_64_intdigest(k)) for k in ("<number>", "<unit>", "<name>")}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Forms of a window: names are words, names are slots, all tokens are as they stand, or names and
#: capitalised openers of sentences are slots; the last is hashed as the second.
_WORDS, _NAMED, _EXACT, _OPENED = range(4)
_SHAPES = tuple((size, form) for form in (_WORDS, _NAMED, _EXACT, _OPENED) for size in range(1, W + 1) if form == _EXACT or size >= MIN_ITEM)


def _classify(token: str) -> tuple[int, int]:
    if token.isalpha():  # most tokens: a word without punctuation
        low = token.lower()
        return xxhash.xxh3_64_intdigest(low), _UNIT * (low in UNITS) | _CAPITAL * token[0].isupper()
    core = token.strip(PUNCTUATION)
    kind = _END * (token.rstrip("\"')]»”’")[-1:] in ".!?:")
    if not core:
        return 0, kind | _EMPTY
    low = core.lower()
    kind |= _GLUED * bool(GLUED.search(token))
    kind |= _NUM * bool(NUMBER.fullmatch(core)) | _UNIT * (low in UNITS) | _CAPITAL * core[0].isupper()
    return xxhash.xxh3_64_intdigest(low), kind


class Templates:
    """Turns texts into hashed windows; remembers tokens, up to a bound.

    vocabulary: the lower-cased words that a window may hold, or None for any. A lower-case word
    outside it needs no look at its letters: it is strange, and no window spans it."""

    def __init__(self, vocabulary: frozenset[str] | None = None):
        self.vocabulary = vocabulary
        # a unit is a slot after a number, whether the benchmark has it or not
        known = [w for w in sorted(vocabulary | UNITS if vocabulary is not None else ()) if w.isalpha() and w.islower()]
        self.known = dict(zip(known, range(1, 1 + len(known)), strict=True))
        self.first = 1 + len(known)
        self.memo: dict[str, int] = {}
        self._room(MEMO_TOKENS)

    def _room(self, tokens: int) -> None:
        self.memo.clear()
        self.hashes, self.kinds = np.zeros(self.first + tokens, np.uint64), np.zeros(self.first + tokens, np.uint8)
        self.kinds[0] = _STRANGE
        for w, at in self.known.items():
            self.hashes[at], self.kinds[at] = self._classify(w)

    def _ids(self, rows: list[list[str]]) -> np.ndarray:
        words = list(chain.from_iterable(rows))
        if self.vocabulary is None:
            return self._remembered(words)
        ids = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        # words of anything but a to z are looked at; words hold no spaces, so one joins them
        codes = np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32)
        gaps = codes == 32
        odd = np.zeros(len(words), bool)
        odd[np.cumsum(gaps)[~gaps & ((codes < 97) | (codes > 122))]] = True
        ids[odd] = self._remembered(list(compress(words, odd.tolist())))
        return ids

    def _remembered(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            fresh = list(dict.fromkeys(words[k] for k in missing.tolist()))
            if self.first + len(self.memo) + len(fresh) > len(self.hashes):
                fresh, missing = list(dict.fromkeys(words)), np.arange(len(words))
                self._room(max(MEMO_TOKENS, len(fresh)))
            start = self.first + len(self.memo)
            self.memo.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            hashes, kinds = zip(*map(self._classify, fresh), strict=True)
            self.hashes[start : start + len(fresh)], self.kinds[start : start + len(fresh)] = hashes, kinds
            ids[missing] = [self.memo[words[k]] for k in missing.tolist()]
        return ids

    def _classify(self, token: str) -> tuple[int, int]:
        h, kind = _classify(token)
        return h, kind | _STRANGE * (self.vocabulary is not None and token.strip(PUNCTUATION).lower() not in self.vocabulary)

    def windows(self, texts: list[str | None], shapes: tuple[tuple[int, int], ...] = _SHAPES, whole_short: bool = False):
        """Yields owners, positions, hashes, the size, the form and a function to the slots of the
        k-th window, for each of the shapes (size, form).

        whole_short: texts of fewer than W tokens are one window of their own size."""
        rows = [t.split() if t else [] for t in texts]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        ids = self._ids(rows)
        glued = np.unique(owner[(self.kinds[ids] & _GLUED) > 0])
        if len(glued):  # "7kg" is a number and a unit
            for k in glued.tolist():
                rows[k] = GLUED.sub(" ", texts[k]).split()
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            ids = self._ids(rows)
        base = np.cumsum([0, *(len(r) for r in rows)])
        kind = self.kinds[ids]
        full = (kind & _EMPTY) == 0
        end = (kind & _END) > 0
        first = np.ones(len(ids), bool)
        first[1:] = (owner[1:] != owner[:-1]) | end[:-1]
        flat, ids, kind, owner, first = np.flatnonzero(full), ids[full], kind[full], owner[full], first[full]
        n = len(ids)
        number = (kind & _NUM) > 0
        unit = np.zeros(n, bool)
        unit[1:] = ((kind[1:] & _UNIT) > 0) & number[:-1] & (owner[1:] == owner[:-1])
        capital = ((kind & _CAPITAL) > 0) & ~number & ~unit
        name, opener = capital & ~first, capital & first
        counts = np.bincount(owner, minlength=len(rows))
        starts = np.cumsum(counts) - counts
        position = np.arange(n) - starts[owner]
        left = counts[owner] - position
        sums = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        slots_of = {_WORDS: number | unit, _NAMED: number | unit | name, _EXACT: np.zeros(n, bool), _OPENED: number | unit | capital}
        needed = {_NAMED: sums(name), _OPENED: sums(opener)}
        values = sums(slots_of[_WORDS])
        for form in sorted({f for _, f in shapes}):
            slot = slots_of[form]
            named = {_NAMED: name, _OPENED: capital}.get(form)
            slots_before, strange = sums(slot), sums(((kind & _STRANGE) > 0) & ~slot)
            for size in sorted(z for z, f in shapes if f == form):
                if n < size:
                    continue
                m = n - size + 1
                ok = left[:m] >= size
                if form != _EXACT:
                    ok &= slots_before[size:] - slots_before[:m] <= size - size // 2
                elif size >= MIN_ITEM:  # others have no form with placeholders
                    ok &= values[size:] - values[:m] > size - size // 2
                if self.vocabulary is not None:
                    ok &= strange[size:] == strange[:m]
                if form in needed:
                    ok &= needed[form][size:] > needed[form][:m]
                if size < MIN_ITEM or whole_short and size < W:
                    ok &= counts[owner[:m]] == size
                at = np.flatnonzero(ok)
                h = np.zeros(len(at), np.uint64)
                for k in range(size):
                    here = at + k
                    token = self.hashes[ids[here]]
                    if form != _EXACT:
                        token = np.where(number[here], _PLACES["<number>"], np.where(unit[here], _PLACES["<unit>"], token))
                    if named is not None:
                        token = np.where(named[here], _PLACES["<name>"], token)
                    h ^= h >> np.uint64(29)
                    h *= _MULTIPLIER
                    h += token
                h ^= h >> np.uint64(32)
                h *= _MULTIPLIER
                h ^= np.uint64(4 * size + (_NAMED if form == _OPENED else form))

                def slots(k: int, at=at, size=size, slot=slot) -> list[str]:
                    own = range(int(at[k]), int(at[k]) + size)
                    return [rows[owner[j]][flat[j] - base[owner[j]]].strip(PUNCTUATION).lower() for j in own if slot[j]]

                yield owner[at], position[at], h, size, form, slots


def _bench_windows(batches):
    made = Templates()
    for batch in batches:
        items, out = batch.column("item_id"), []
        for owner, position, h, size, form, slots in made.windows(batch.column("text").to_pylist(), whole_short=True):
            out += [(o, int(x), p, size, form, slots(k)) for k, (o, p, x) in enumerate(zip(owner.tolist(), position.tolist(), h.astype(np.int64), strict=True))]
        yield pa.RecordBatch.from_arrays(
            [items.take(pa.array([x[0] for x in out], pa.int64())), *(pa.array([x[c] for x in out], t) for c, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32()), (5, pa.list_(pa.string()))))],
            ["item_id", "h", "ipos", "size", "form", "islots"],
        )


def _bench_tokens(batches):
    """All words of the benchmark, whatever they may be classified as."""
    for batch in batches:
        words = {w.strip(PUNCTUATION).lower() for t in batch.column("text").to_pylist() if t for w in GLUED.sub(" ", t).split()}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])


_made: dict[str, Templates] = {}


def _templates(index: np.ndarray | None, vocabulary: frozenset[str] | None) -> Templates:
    """The worker's templates for this benchmark: what they remember serves its later tasks too."""
    key = "" if index is None else xxhash.xxh3_128_hexdigest(index.tobytes())
    if key not in _made:
        _made.clear()
        _made[key] = Templates(vocabulary)
    return _made[key]


def _doc_windows(shapes: tuple[tuple[int, int], ...], held=None):
    """held: a broadcast of the sorted hashes that a window must be among and of the words that it may have; or None for all."""

    def run(batches):
        index, vocabulary = held.value if held is not None else (None, None)
        made = _templates(index, vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, length in slices(texts, 1 << 20):
                out = []
                for owner, position, h, _, form, slots in made.windows(texts.slice(start, length).to_pylist(), shapes):
                    found = np.arange(len(h))
                    if index is not None:
                        place = np.minimum(np.searchsorted(index, h), max(0, len(index) - 1))
                        found = np.flatnonzero(index[place] == h) if len(index) else found[:0]
                    out += [(start + int(owner[k]), int(h[k].astype(np.int64)), int(position[k]), form == _OPENED, slots(k)) for k in found.tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.bool_()), pa.array([x[4] for x in out], pa.list_(pa.string()))],
                        ["doc_id", "h", "pos", "opened", "dslots"],
                    )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows (matched, in the best alignment), item_windows, changed_slots."""
    made = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_bench_windows, "item_id long, h long, ipos long, size int, form int, islots array<string>")
    bench = materialize(made.distinct(), "bench-windows")
    placed = F.col("form") != _EXACT
    totals = bench.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows"), F.countDistinct(F.when(placed, F.col("ipos"))).alias("placed_windows"))
    # a shape that the benchmark lacks meets nothing
    shapes = {(r["size"], r["form"]) for r in bench.select("size", "form").distinct().collect()}
    shapes |= {(size, other) for size, form in shapes for other in (_NAMED, _OPENED) if form in (_NAMED, _OPENED)}  # they meet each other
    shapes = tuple(sorted(shapes))
    slot_bytes = F.aggregate("islots", F.lit(0), lambda n, x: n + 24 + F.octet_length(x))
    n, size = bench.agg(F.count("*"), F.sum(64 + slot_bytes)).first()
    few, held = n <= broadcast_windows and (size or 0) <= BROADCAST_BYTES, None
    if few:
        index = np.unique(bench.select("h").distinct().toPandas()["h"].to_numpy(np.int64).astype(np.uint64))
        words = benchmark.select("text").mapInArrow(_bench_tokens, "word string").distinct()
        held = docs.sparkSession.sparkContext.broadcast((index, frozenset(words.toPandas()["word"].tolist())))
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_doc_windows(shapes, held), "doc_id long, h long, pos long, opened boolean, dslots array<string>")
    totals = totals.withColumnRenamed("item_id", "_item")
    items = bench.join(F.broadcast(totals) if few else totals, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "h", "ipos", "form", "islots", "item_windows", "placed_windows")
    met = found.join(F.broadcast(items) if few else items.hint("merge"), "h")
    # an alignment counts without windows of openers and with them
    opened = F.col("opened") | (F.col("form") == _OPENED)
    met = met.withColumn("level", F.explode(F.when(opened, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    pairs = F.arrays_zip(F.col("islots").alias("i"), F.col("dslots").alias("d"))
    aligned = met.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "level", "item_windows", "placed_windows").agg(
        F.countDistinct("ipos").alias("n_windows"), F.countDistinct(F.when(placed, F.col("ipos"))).alias("n_placed"), F.array_distinct(F.flatten(F.collect_list(pairs))).alias("slots")
    )
    # every value of the item stands for one value here
    steady = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    least = lambda total: F.greatest(F.lit(1), F.least(F.ceil(F.col(total) / 2), F.lit(RUN - W + 1)))
    enough = (F.col("n_windows") >= least("item_windows")) | (F.col("n_placed") >= least("placed_windows"))
    changed = F.size(F.filter("slots", lambda s: s["i"] != s["d"])).cast("long")
    leaks = aligned.filter(steady & enough).withColumn("changed_slots", changed)
    best = leaks.groupBy("doc_id", "item_id", "item_windows").agg(F.max(F.struct("n_windows", (-F.col("changed_slots")).alias("same"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_windows").alias("n_windows"), "item_windows", (-F.col("best.same")).alias("changed_slots"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows of a doc_id that is contaminated; rows of a null doc_id are one document."""
    leak = free_name(docs, "leaking_doc")
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(leak)), "left_anti")
