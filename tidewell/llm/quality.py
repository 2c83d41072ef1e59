"""Quality rules: compression bands over whole texts and fixed chunks, beside plain counting rules.

A text's zstandard ratio (compressed bytes / bytes) is held against limits that depend on its length: short
texts compress less, so their band lies higher. Texts of a chunk or more are also cut into chunks of fixed size, the
last of which ends with the text (and overlaps the one before it), and too many chunks outside the chunk band reject a
text that is only in part repetitive or incompressible. A shorter text is one chunk, under the band of its length.
The bands stand just outside the ratios of the rows labelled clean in the given tables, and lose none of them.

Counts are made for all texts of an Arrow batch at once, from arrays a few times its size; windows of words are compared by 64-bit
hashes.

Cases: a null text counts as empty: no words, base_failed, not kept, no ratio. A line is text between line ends, white space
included. Very long texts are one batch's worth of arrays like others. Rows are independent: repeated rows, ties, empty tables and
extra columns need no rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_arrow, pick, utf8
from .words import bounds, hashes, mix, windows

LEVEL = 3
CHUNK = 4096
#: Up to how many bytes, and the least and the greatest ratio allowed. The last band has no end.
BANDS = ((100, 0.55, 1.3), (200, 0.55, 1.05), (500, 0.51, 0.92), (1_000, 0.475, 0.80), (2_000, 0.45, 0.68), (4_000, 0.43, 0.62), (8_000, 0.415, 0.57), (16_000, 0.39, 0.53), (32_000, 0.39, 0.50), (64_000, 0.38, 0.49), (float("inf"), 0.37, 0.49))
CHUNK_BAND = (0.425, 0.56)
#: Share of chunks that may be outside CHUNK_BAND.
CHUNKS_OUTSIDE = 0.1
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
WINDOW = 8
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, worst_chunk double, verdict string"


def repeated_words(h: np.ndarray, firsts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows of `width` words that are found twice or more in it. h: hashes of all words, firsts: words before each text."""
    found, at = windows(h, firsts, width)
    cover = np.zeros(len(h) + 1, np.int64)
    if len(found):
        text = np.searchsorted(firsts, at, "right") - 1
        found = mix(found + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # a window of another text is another one
        order = np.argsort(found, kind="stable")
        same = found[order][1:] == found[order][:-1]
        twice = at[order[np.append(same, False) | np.append(False, same)]]
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + width, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[firsts[1:]] - inside[firsts[:-1]]


def compression(data: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float | None, float | None, str]:
    """Ratio, the chunk ratio farthest from the chunk band's middle, and `ok`, `repetitive` or `incompressible`."""
    if not data:
        return None, None, "ok"
    ratio = len(compressor.compress(data)) / len(data)
    low, high = next((lo, hi) for most, lo, hi in BANDS if len(data) <= most)
    verdict, worst = ("repetitive" if ratio < low else "incompressible" if ratio > high else "ok"), None
    if len(data) >= CHUNK:
        starts = [*range(0, len(data) - CHUNK, CHUNK), len(data) - CHUNK]
        chunks = [len(compressor.compress(data[i : i + CHUNK])) / CHUNK for i in starts]
        worst = max(chunks, key=lambda r: abs(r - sum(CHUNK_BAND) / 2))
        low_n, high_n = sum(r < CHUNK_BAND[0] for r in chunks), sum(r > CHUNK_BAND[1] for r in chunks)
        if verdict == "ok" and low_n + high_n > CHUNKS_OUTSIDE * len(chunks):
            verdict = "repetitive" if low_n >= high_n else "incompressible"
    return ratio, worst, verdict


def measures(column: pa.Array, compressor: zstandard.ZstdCompressor) -> list[list]:
    """The columns of SCHEMA for a column of texts."""
    data, ends = utf8(column)
    starts, stops, firsts = bounds(data, ends, "spaced")
    within = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[ends])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[stops] -= 1
    chars = within((np.cumsum(inside[:-1], dtype=np.int8) > 0) & (data & 0xC0 != 0x80))
    n, symbols, repeats = np.diff(firsts), within(SYMBOLS[data]), repeated_words(hashes(data, starts, stops), firsts)
    failed = (n < 20) | (100 * repeats > 30 * n)
    dups, pressed = [], []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        text = data[a:b].tobytes()
        seen: set[bytes] = set()
        dups.append(0)
        for line in text.split(b"\n"):
            if line.strip():
                dups[-1] += line in seen
                seen.add(line)
        pressed.append(compression(text, compressor))
    kept = [not f and p[2] == "ok" for f, p in zip(failed.tolist(), pressed)]
    return [n.tolist(), chars.tolist(), symbols.tolist(), dups, repeats.tolist(), failed.tolist(), kept, *[list(x) for x in zip(*pressed)]]


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    """The columns of SCHEMA for one text."""
    return tuple(x[0] for x in measures(pa.array([text], pa.string()), compressor))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Counts and verdict of each whole text: id_col, the columns of SCHEMA, and those of `carry` unchanged."""
    kept = pick(docs, id_col, text_col, *[c for c in carry if c not in (id_col, text_col)])
    arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    kinds = [x.split(" ") for x in SCHEMA.split(", ")]
    own = [f for f in kept.schema.fields if f.name == id_col or f.name in carry]
    at = [kept.columns.index(f.name) for f in own]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return pa.RecordBatch.from_arrays([batch.column(i) for i in at] + [pa.array(x, arrow[k]) for x, (_, k) in zip(measures(batch.column(1), compressor), kinds)], names=[f"c{i}" for i in at] + [k for k, _ in kinds])

    out = map_arrow(kept, run, ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in zip(at, own)] + [SCHEMA]))
    return out.toDF(*[f.name for f in own], *[k for k, _ in kinds])
