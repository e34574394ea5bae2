"""SentencePiece encoding and decoding of whole texts, for models of merge type (BPE).

Each prefix of a text has exactly one last token: if t1 ... tn is the encoding of a text, t1 ... ti
is that of the prefix they spell, and a row of tokens is an encoding if and only if each pair of
neighbours is one by itself (a merge across a boundary depends on nothing but the two tokens
beside it). So `PieceTable.encode` walks an automaton of all pieces over the text; of the pieces
that end at a place it stores the one that is compatible with the last token of the prefix before
it, tested by merging the pair alone (remembered), and the ids are read backwards from the end of
this table. If none of several characters is, the last one is a token of its own: its id if it is a
piece, else the ids of its UTF-8 bytes. The work is proportional to the text however it looks.

No piece of the common models has a space mark after another character. Where that holds of a
model, a text falls into words that no token spans, and a worker remembers the ids of short words,
up to a bound. Texts are handled in slices of bounded size, long ones in runs of words, so only
the ids and the decoded text of one document are held whole.

`encode` and `decode` work row by row: no shuffle, and a lost task is simply run again. Text is
normalised, and ids are decoded, by the model's own library.

Defined results: null and empty texts have no ids and decode to an empty text; a null list of ids
decodes to null; a text of one endless word or of white space alone is one word; repeated rows and
ties of ids give a row each; an empty table gives an empty result; other columns are kept, but for
`ids` and `decoded`, which are replaced. Models with unused pieces are an error.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
#: Words that a worker remembers before it starts anew, and their greatest length.
MEMO_WORDS, MEMO_CHARS = 500_000, 64
#: Pairs of pieces whose compatibility is remembered.
MEMO_PAIRS = 1_000_000
#: Words encoded, and ids decoded, at a time.
RUN = 1 << 18
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceTable:
    """A model's pieces, their automaton, and the tests of pairs."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        if any(m.is_unused(i) for i in range(len(m))):
            raise ValueError("models with unused pieces are not supported")
        plain = [i for i in range(len(m)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.scores = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.pieces = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()
        by_byte = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = by_byte if all(m.is_byte(i) for i in by_byte) else None
        self.by_words = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text, merge by merge: the best score first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether these two tokens are the encoding of what they spell. left may be empty."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def encode_word(self, word: str) -> bytes:
        """The ids of a word, as int32."""
        known = self.pairs.get
        last = ["", *word]  # of each prefix: a single character unless a longer piece fits
        for end, piece in self.pieces.iter(word):  # the longest of an end first
            if len(last[end + 1]) == 1:
                left = last[end + 1 - len(piece)]
                fits = known((left, piece))
                if fits or fits is None and self.compatible(left, piece):
                    last[end + 1] = piece
        out, at = [], len(word)
        while at:
            token = last[at]
            at -= len(token)
            found = self.ids.get(token)
            if found is not None:
                out.append(found)
            elif self.bytes is None:
                if not out or out[-1] != self.model.unk_id():  # neighbours unknown are one token
                    out.append(self.model.unk_id())
            else:
                out.extend(self.bytes[b] for b in reversed(token.encode()))
        return array("i", out[::-1]).tobytes()

    def split(self, text: str):
        """Words that no token spans."""
        if not self.by_words:
            return iter([text] if text else [])
        if text.startswith(MARK) and MARK * 2 not in text:
            return (MARK + word for word in text[1:].split(MARK))
        return (m.group() for m in WORDS.finditer(text))

    def encode(self, text: str) -> np.ndarray:
        words, memo, runs = self.split(self.model.normalize(text)), self.words, []
        while run := list(islice(words, RUN)):
            if len(memo) > MEMO_WORDS:
                memo.clear()
            fresh = {w: self.encode_word(w) for w in set(run).difference(memo)}
            memo.update(fresh)
            runs.append(b"".join(map(memo.__getitem__, run)))
            for w in fresh:
                if len(w) > MEMO_CHARS:
                    del memo[w]
        return np.frombuffer(b"".join(runs), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) <= RUN:
            return self.model.decode(ids.tolist())
        # only the start of a text is special to the decoder: later runs follow a known piece; none starts within the bytes of a character
        out, at, lead = [], 0, next(p for p in self.ids if len(p) == 1 and p != MARK)
        while at < len(ids):
            end = min(len(ids), at + RUN)
            while end < len(ids) and self.model.is_byte(int(ids[end])):
                end += 1
            run = ids[at:end].tolist()
            out.append(self.model.decode([self.ids[lead], *run])[len(lead) :] if at else self.model.decode(run))
            at = end
        return "".join(out)


_tables: dict[str, PieceTable] = {}


def table_of(path: str) -> PieceTable:
    """The worker's table of a model: what it remembers serves later tasks too."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _encode(path: str, names: list[str], text: str):
    def run(batches):
        table = table_of(path)
        for batch in batches:
            for start, length in slices(batch.column(text)):
                part = batch.slice(start, length)
                ids = [table.encode(x or "") for x in part.column(text).to_pylist()]
                new = {"ids": lambda ids=ids: _lists(ids), "decoded": lambda ids=ids: pa.array([table.decode(x) for x in ids], pa.string())}
                yield pa.RecordBatch.from_arrays([new[n]() if n in new else part.column(n) for n in names], names)

    return run


def encode(docs: DataFrame, model_path: str, text: str = "text", decoded: bool = False, drop_text: bool = False) -> DataFrame:
    """docs with ids array<int> of each whole text; decoded adds what they decode to in the same pass."""
    docs = docs.drop(*{"ids", "decoded"} - {text})
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text)]
    names = [*(f.name for f in kept), "ids", *["decoded"] * decoded]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " * bool(kept)
    return docs.mapInArrow(_encode(model_path, names, text), f"{kinds}ids array<int>" + ", decoded string" * decoded)


def _decode(path: str, names: list[str]):
    def run(batches):
        table = table_of(path)
        for batch in batches:
            column = batch.column("ids")
            for at in range(len(batch)):
                # one document at a time: its decoded text may be long
                ids = column[at]
                row = batch.slice(at, 1)
                made = None if not ids.is_valid else table.decode(ids.values.to_numpy(zero_copy_only=False).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.string()) if n == "decoded" else row.column(n) for n in names], names)

    return run


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """tokens(ids, ...) with decoded, the text that the library gives for the ids."""
    tokens = tokens.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decode(model_path, [*tokens.columns, "decoded"]), f"{kinds}, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """encoded(doc_id, ids, decoded) as counts and digests."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
