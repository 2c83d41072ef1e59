"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece (a match of the tokenizer's pre-split pattern) exactly one token can be the last
one of its encoding. A vocabulary automaton lists the tokens that end at a position; of these the one that is
compatible with the last token of the prefix before it is stored, and back-pointers give the ids. Two
tokens are compatible if BPE, run on their joined bytes, would leave them side by side: while the boundary is
unmerged, no merge across it may come earlier than the merges that build the two tokens.

Cases: null and empty texts give no ids and decode to the empty text; texts of any length are handled piece by
piece; the special token's string in a text is its id, as in the tokenizers library. Rows are independent, so
ties, repeated rows, empty tables and extra columns need no rule: one row out for each row in.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, pick

#: Pieces in each half of a Python worker's memory. Speed only.
REMEMBERED = 170_000
#: Token pairs that it remembers; beyond that the memory starts anew. Speed only.
PAIRS = 300_000
#: The byte-level pre-split. White space is that of Unicode, as in the tokenizer's own engine.
SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SCHEMA = "n_tokens long, ids binary, ids_sha256 string, decoded string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        ids = {raw(k): v for k, v in vocab.items()}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank, token
        self.built: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (ids[raw(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            t = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merged.setdefault((a, b), (rank, t))
            self.built.setdefault(t, (rank, a, b))
        self.automaton = ahocorasick.Automaton()
        self.pairs: dict[int, bool] = {}
        for b, i in ids.items():
            if self.whole(i):  # a token that BPE never makes of its own bytes is never a last token
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.pairs.clear()
        self.split = regex.compile(PATTERN).findall
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.pieces = Pieces(self)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one edge (1: left, 2: right) of a token while it is built, latest first, each with the rank at which it goes into the next."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.built:
                return out
            until = self.built[token][0]
            token = self.built[token][side]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        left, right = self.spine(a, 2), self.spine(b, 1)
        i, j, fits = len(left) - 1, len(right) - 1, True
        while fits:  # from the bare bytes on, as the ranks rise
            (x, x_until), (y, y_until) = left[i], right[j]
            if (m := self.merged.get((x, y))) and m[0] < x_until and m[0] <= y_until:
                fits = False  # the merge across the boundary comes first; of equal ranks the leftmost does
            elif i == 0 and j == 0:
                break
            elif x_until <= y_until:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = fits
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        last: list[int] = [-1] * len(data)  # the last token of the prefix that ends here
        known, compatible = self.pairs, self.compatible
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if last[end] >= 0:
                continue
            before = end - size
            if before < 0:
                last[end] = token
            elif (a := last[before]) >= 0:
                fits = known.get(a << 32 | token)
                if compatible(a, token) if fits is None else fits:
                    last[end] = token
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def whole(self, token: int) -> bool:
        """Whether BPE makes this token of its bytes: each half is whole and the halves stay until they meet."""
        key = -1 - token
        if (known := self.pairs.get(key)) is not None:
            return known
        fits = True
        if token in self.built:
            rank, a, b = self.built[token]
            left, right = self.spine(a, 2), self.spine(b, 1)
            fits = self.whole(a) and self.whole(b)
            i, j = len(left) - 1, len(right) - 1
            while fits and (i or j):
                (x, x_until), (y, y_until) = left[i], right[j]
                if (m := self.merged.get((x, y))) and m[0] < x_until and m[0] <= y_until:
                    fits = False
                elif x_until <= y_until:
                    i -= 1
                else:
                    j -= 1
        self.pairs[key] = fits
        return fits

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.apart and any(s in text for s in self.special):
            return b"".join(np.uint32(self.special[part]).tobytes() if part in self.special else self.encode_plain(part) for part in self.apart(text) if part)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Pieces(dict):
    """Encoded pieces, made when first asked for. Those used since the older half was closed move on, the rest is forgotten."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("I", self.codec.encode_piece(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each vocabulary and Python process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns id_col and those of `outputs` asked for: n_tokens long, ids (binary, little-endian uint32), ids_sha256,
    decoded, decoded_sha256.
    """
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = codec(vocabulary), {k: [] for k in kinds}
        for text in batch.column(1).to_pylist():
            ids = c.encode_bytes(text or "")
            rows["n_tokens"].append(len(ids) // 4)
            if "ids" in outputs:
                rows["ids"].append(ids)
            if "ids_sha256" in outputs:
                rows["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            if "decoded" in outputs or "decoded_sha256" in outputs:
                decoded = c.decode(np.frombuffer(ids, "<u4").tolist())
                if "decoded" in outputs:
                    rows["decoded"].append(decoded)
                rows["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[k], arrow[kinds[k]]) for k in outputs]], names=["id", *outputs])

    out = map_arrow(pick(docs, id_col, text_col), encode, ", ".join([f"`id` {id_type}", *[f"{k} {kinds[k]}" for k in outputs]]))
    return out.withColumnRenamed("id", id_col)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file of lines `base64 rank`: the same vocabulary in another form, used in tests."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
