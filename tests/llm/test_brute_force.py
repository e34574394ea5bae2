"""Operators that SQL cannot express, against plain versions of what they compute."""

from __future__ import annotations

import collections
import itertools
import math

import numpy as np
import pytest
from test_corpus import AWKWARD, LONG, documents, near_texts

from mosaicell.llm import common, decontam, media, ngram_join, registry, token_counts, toxicity, url_filter

# ------------------------------------------------------------------ toxicity


def plain_score(model, text):
    """The forward pass with one word, filter and place at a time."""
    words = toxicity.words_of(text)

    def vector(word):
        ids = [x for x in toxicity.word_features(word) if x]
        return sum(model.emb[x].astype(float) for x in ids) / len(ids)

    at = lambda k: vector(words[k]) if k < len(words) else np.zeros(toxicity.DIM)
    hidden, block = [], 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            taps = [model.taps[:, (block + k) * toxicity.FILTERS + f].astype(float) for k in range(width)]
            best = max(sum(at(p + k) @ taps[k] for k in range(width)) for p in range(len(words) + 1))
            hidden.append(max(0.0, best + model.bias[len(hidden)]))
        block += width
    z = np.dot(hidden, model.out) + model.out_bias - model.shift[toxicity.guess_language(words, toxicity._lookup())]
    return 1 / (1 + math.exp(-min(30, max(-30, z + math.log(toxicity.CUT / (1 - toxicity.CUT))))))


def test_scores_equal_a_plain_forward_pass(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"wort{rng.integers(60)}"
    texts = [" ".join(word() for _ in range(int(rng.integers(1, 30)))) + (" schuft" if i % 3 == 0 else "") for i in range(90)]
    model = toxicity.fit(texts, np.array([int(i % 3 == 0) for i in range(90)]))
    asked = texts + [t for t in AWKWARD if t != LONG] + ["the and of", "der die das schuft", "x"]
    rows = toxicity.score(documents(spark, asked), model).collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert abs(r.score - plain_score(model, r.text)) < 1e-4
    # neither the rows beside a text nor their order enter its score
    other = {r.text: r.score for r in toxicity.score(documents(spark, asked[::-1]).coalesce(1), model).collect()}
    assert all(abs(other[r.text] - r.score) < 1e-6 for r in rows)


# ------------------------------------------------------------------ urls


def plain_features(url, model):
    host, _, path = "", "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = host.lower()
    url = url or ""
    shares = [n / len(host) for n in collections.Counter(host).values()]
    suffix = ".".join(host.split(".")[-2:])
    seen = model.suffixes.get(suffix, (0.0, sum(n * m for n, m in model.suffixes.values()) / sum(n for n, _ in model.suffixes.values())))
    ends = sum(c in "?&" and "=" in url[k + 1 :] and url[k + 1] not in "=&#" and not set("&#") & set(url[k + 1 : url.index("=", k + 1)]) for k, c in enumerate(url))
    return {
        "url_length": len(url), "host_length": len(host), "path_length": len(path),
        "depth": sum(c == "/" and path[k + 1 : k + 2] not in ("", "/") for k, c in enumerate(path)),
        "digit_ratio": sum(c in "0123456789" for c in url) / max(1, len(url)),
        "host_entropy": -sum(p * math.log2(p) for p in shares), "host_hyphens": host.count("-"),
        "host_labels": sum(bool(x) for x in host.split(".")), "parameters": ends, "suffix_count": seen[0], "suffix_mean": seen[1],
    }


def test_verdicts_equal_plain_trees(spark):
    rng = np.random.default_rng(2)
    name = lambda: "".join(rng.choice(list("abcdefgh-"), 7))
    urls = [f"http://{name()}.{'shop' if rng.random() < 0.5 else 'info'}/{'a/' * int(rng.integers(4))}{int(rng.integers(999))}{'?x=1&y=2' if rng.random() < 0.4 else ''}" for _ in range(400)]
    labels = [int(u.count("-") > 0 and rng.random() < 0.9 or "?x" in u and rng.random() < 0.5) for u in urls]
    model = url_filter.train(spark.createDataFrame(list(zip(urls, labels, strict=True)), "url string, label int"), trees=5)
    assert len(model.trees) == 5

    def walk(node, own):
        return node if isinstance(node, float) else walk(node[2] if own[node[0]] <= node[1] else node[3], own)

    asked = urls[:60] + [None, "", "no scheme", "http://new.suffix.example/?a=&b=2#c=3", "http://UPPER.shop/x//y"]
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in enumerate(asked)], "page_id long, url string, host string, score double")
    rows = {r.page_id: r for r in url_filter.judge(pages.unionByName(pages), model, ()).collect()}
    assert len(rows) == len(asked)
    for i, u in enumerate(asked):
        own = plain_features(u, model)
        score = 1 / (1 + math.exp(-(model.base + sum(walk(t, own) for t in model.trees))))
        assert abs(rows[i].score - score) < 1e-9 and rows[i].verdict == ("block" if score >= 0.5 else "allow")
    assert url_filter.judge(pages.limit(0), model).count() == 0
    none = url_filter.train(spark.createDataFrame([], "url string, label int"))
    assert {r.verdict for r in url_filter.judge(pages, none, ()).collect()} == {"allow"}


def test_a_sampled_label_counts_as_often_as_it_occurs(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TRAIN_ROWS", 50)
    rows = [(f"http://h.example/{i}", int(i % 10 == 0)) for i in range(1000)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, label int"), trees=1)
    assert abs(model.base - math.log(100 / 900)) < 1e-9


# ------------------------------------------------------------------ decontamination


def plain_tokens(text):
    out, opens = [], True
    for token in decontam.GLUED.sub(" ", text or "").split():
        core, first = token.strip(decontam.PUNCTUATION), opens
        opens = token.rstrip("\"')]»”’")[-1:] in tuple(".!?:")
        if core:
            number = bool(decontam.NUMBER.fullmatch(core))
            unit = core.lower() in decontam.UNITS and bool(out) and out[-1][1] == "number"
            capital = core[0].isupper() and not number and not unit
            out.append((core.lower(), "number" if number else "unit" if unit else ("opener" if first else "name") if capital else "word"))
    return out


def plain_windows(text, whole_short):
    """(key, position, form, slots): the key is what two windows have to share."""
    tokens, found = plain_tokens(text), []
    slots_of = {"words": ("number", "unit"), "named": ("number", "unit", "name"), "exact": (), "opened": ("number", "unit", "name", "opener")}
    for form, slots in slots_of.items():
        for size in range(1 if form == "exact" else decontam.MIN_ITEM, decontam.W + 1):
            if (size < decontam.MIN_ITEM or whole_short and size < decontam.W) and len(tokens) != size:
                continue
            for p in range(len(tokens) - size + 1):
                part = tokens[p : p + size]
                kinds = [k for _, k in part]
                values = sum(k in ("number", "unit") for k in kinds)
                if form == "exact":
                    fits = size < decontam.MIN_ITEM or values > size - size // 2
                else:
                    fits = sum(k in slots for k in kinds) <= size - size // 2
                fits &= form != "named" or "name" in kinds
                fits &= form != "opened" or "opener" in kinds
                if fits:
                    place = lambda w, k, s=slots: (w if k not in s else f"<{'name' if k == 'opener' else k}>")
                    key = ("named" if form == "opened" else form, tuple(place(w, k) for w, k in part))
                    found.append((key, p, form, [w for w, k in part if k in slots]))
    return found


def plain_leaks(docs, items):
    out = set()
    least = lambda total: max(1, min(math.ceil(total / 2), decontam.RUN - decontam.W + 1))
    for (d, text), (i, item) in itertools.product(docs.items(), items.items()):
        theirs = plain_windows(item, True)
        total, placed = len({p for _, p, _, _ in theirs}), len({p for _, p, f, _ in theirs if f != "exact"})
        by_key = collections.defaultdict(list)
        for key, p, form, slots in theirs:
            by_key[key].append((p, form, slots))
        sizes = {(len(k[1]), k[0]) for k, *_ in theirs}
        met = collections.defaultdict(list)
        for key, p, form, slots in plain_windows(text, False):
            if (len(key[1]), key[0]) in sizes:
                for q, other, own in by_key.get(key, ()):
                    for level in (1,) if "opened" in (form, other) else (0, 1):
                        met[p - q, level].append((q, other, list(zip(own, slots, strict=True))))
        best = []
        for rows in met.values():
            pairs = {x for *_, slots in rows for x in slots}
            n, n_placed = len({q for q, *_ in rows}), len({q for q, f, _ in rows if f != "exact"})
            if len({a for a, _ in pairs}) == len(pairs) and (n >= least(total) or n_placed >= least(placed)):
                best.append((n, -sum(a != b for a, b in pairs)))
        if best:
            n, same = max(best)
            out.add((d, i, n, total, -same))
    return out


@pytest.mark.parametrize("limit", [10**6, 0])
def test_leaks_equal_a_plain_search(spark, limit):
    rng = np.random.default_rng(8)
    words = ["the", "red", "bus", "drove", "along", "a", "river", "and", "stopped", "when", "it", "saw"]
    values = lambda: str(rng.integers(100)) + rng.choice(["", " km", "kg", " miles", ",", "."])
    names = ["Anna", "Bert", "Carla", "Emil", "Mr. Frank"]

    def sentence(n):
        some = [str(rng.choice(words)) if rng.random() < 0.7 else values() if rng.random() < 0.6 else str(rng.choice(names)) for _ in range(n)]
        return " ".join(some) + str(rng.choice([".", "", "!", " -"]))

    items = {k: " ".join(sentence(int(rng.integers(2, 9))) for _ in range(int(rng.integers(1, 4)))) for k in range(14)}
    items |= {50: "12 + 30 + 18", 51: "Go", 52: "", 53: None}
    docs = {}
    for k in range(60):
        item = (items[int(rng.integers(14))] or "").split()
        for at in range(len(item)):
            if item[at][:1].isdigit() and rng.random() < 0.5:
                item[at] = values().strip()
            elif item[at] in names and rng.random() < 0.5:
                item[at] = str(rng.choice(names))
            elif rng.random() < 0.04:
                item[at] = str(rng.choice(words))
        docs[k] = sentence(int(rng.integers(0, 8))) + " " + " ".join(item) + " " + sentence(int(rng.integers(0, 8)))
    docs |= {100 + k: t for k, t in enumerate(AWKWARD) if t != LONG} | {200: "12 + 30 + 18 and", 201: "Go", 202: "12, 30 - 18", 203: "Go on"}
    found = decontam.find_leaks(
        spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), limit
    ).collect()
    want = plain_leaks(docs, items)
    assert {tuple(r) for r in found} == want and len(want) > 30


# ------------------------------------------------------------------ pictures


def plain_link(a, b):
    """Whether two pictures' corners agree on one transformation; all corners are compared."""
    x, y = (np.stack(media.describe(p[None].astype(np.float32))[1:], 1) for p in (a, b))
    if not len(x) or not len(y):
        return False
    bits = lambda c: np.unpackbits(np.ascontiguousarray(c[:, 4:6]).view(np.uint8).reshape(len(c), -1), axis=1).astype(int)
    i, j = np.nonzero((bits(x)[:, None] != bits(y)[None]).sum(2) <= media.MAX_BITS)
    best = 0
    for one, two, k, m in ((x, y, i, j), (y, x, j, i)):
        p, q = one[k], two[m]
        turn = (q[:, 3] - p[:, 3]) % media.ANGLES
        quarter = (turn + 1) // (media.ANGLES // 4) * (media.ANGLES // 4)
        turn = np.where(abs(turn - quarter) <= 1, quarter, turn) % media.ANGLES
        angle, grow = turn * 2 * np.pi / media.ANGLES, 2.0 ** (q[:, 2] - p[:, 2])
        dx = q[:, 0] - grow * (np.cos(angle) * p[:, 0] - np.sin(angle) * p[:, 1])
        dy = q[:, 1] - grow * (np.sin(angle) * p[:, 0] + np.cos(angle) * p[:, 1])
        for shift in (0.0, 0.5):
            votes = collections.defaultdict(set)
            for s, t, u, v, own in zip(q[:, 2] - p[:, 2], np.floor(turn / 4 + shift), np.floor(dx / media.GRID + shift), np.floor(dy / media.GRID + shift), map(tuple, p[:, :4]), strict=True):
                votes[s, t, u, v].add(own)
            best = max([best, *map(len, votes.values())])
    return best >= media.MIN_INLIERS and best >= media.MIN_SHARE * min(len(x), len(y))


def test_links_reach_the_recall_of_a_search_through_all_pairs(spark):
    rng = np.random.default_rng(6)
    vectors = []
    for i in range(40):
        v = rng.normal(0, 1, 64)
        vectors += [(3 * i, v), (3 * i + 1, v + rng.normal(0, 0.08, 64)), (3 * i + 2, v + rng.normal(0, 0.2, 64))]
    pictures = {i: media.decode_pgm(media.draw(v)) for i, v in vectors}
    queries = [i for i in pictures if i % 20 == 0]
    want = {(q, i) for q in queries for i in pictures if i != q and plain_link(pictures[q], pictures[i])}
    rows = media.copies(media.render_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "id long, vector array<double>"))).collect()
    found = {r.id: r.class_id for r in rows}
    assert len(want) >= 8 and np.mean([found[a] == found[b] for a, b in want]) >= 0.9
    assert all(found[q] != found[i] or i // 3 == q // 3 for q in queries for i in pictures)  # strangers stay apart
    assert all(found[3 * i] == found[3 * i + 1] for i in range(40))


# ------------------------------------------------------------------ near duplicates


def test_candidates_grow_with_the_group(spark, monkeypatch):
    """Two hubs and G near copies that link with the second alone: no pairs of copies are made."""
    counts = {}

    def counted(df, name, real=common.materialize):
        out = real(df, name)
        if name in ("met", "stars"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    for size in (50, 100, 200):
        base = [f"w{k}" for k in range(200)]
        texts = [" ".join([*base[:150], *[f"hub{k}" for k in range(60)]]), " ".join(base)]
        texts += [" ".join([*base[:199], f"own{i}"]) for i in range(size)]
        rows = ngram_join.label(documents(spark, texts)).collect()
        assert {r.component_id for r in rows if r.doc_id} == {1} and counts["met"] + counts["stars"] <= 4 * size


def test_shapes_of_near_groups_equal_brute_force(spark):
    """Chains, rings around hubs and groups that only differences connect."""
    from test_corpus import brute_components

    rng = np.random.default_rng(11)
    texts = near_texts()[:20]
    for g in range(12):
        base = [f"g{g}x{k}" for k in range(int(rng.integers(30, 120)))]
        shared = [f"g{g}y{k}" for k in range(len(base))]
        at = list(base)
        for i in range(14):
            if i % 3 == 0:  # a chain: each a little further from the first
                at = list(at)
                for k in rng.choice(len(base), max(1, len(base) // 30), replace=False):
                    at[k] = f"c{g}n{i}k{k}"
                texts.append(" ".join(at))
            else:  # the same differences from the first in several texts
                cut = int(len(base) * rng.choice([0.02, 0.05, 0.1, 0.15, 0.2]))
                texts.append(" ".join([*base[: len(base) - cut], *shared[:cut]]))
    docs = documents(spark, texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.label(docs).collect()} == brute_components(texts)


# ------------------------------------------------------------------ tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_whole_texts(spark, tmp_path, name):
    path = registry.tokenizer_path(name)
    texts = [t for t in AWKWARD if t != LONG] + ["a  b", " a", "it's <|endoftext|> x", "Été 日本"]
    if name.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        want = [len(pieces.encode(t or "")) for t in texts]
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        want = [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = {r.doc_id: r.n_tokens for r in token_counts.count(documents(spark, texts), path, str(tmp_path / "cache")).collect()}
    assert got == dict(enumerate(want))


def test_only_plain_byte_level_tokenizers_are_cut_at_spaces():
    plain = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": [{"content": "<x>"}]}
    assert token_counts.splits_at_spaces(plain)
    assert not token_counts.splits_at_spaces(plain | {"normalizer": {"type": "NFC"}})
    assert not token_counts.splits_at_spaces(plain | {"added_tokens": [{"content": "a b"}]})
    assert not token_counts.splits_at_spaces(plain | {"added_tokens": [{"content": "<x>", "lstrip": True}]})
    assert not token_counts.splits_at_spaces(plain | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})
    assert not token_counts.splits_at_spaces({"pre_tokenizer": None})
