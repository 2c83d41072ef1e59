"""Language identification by error-correcting output codes.

Every language has a codeword of +1/-1 bits. Each bit has a linear classifier over hashed byte n-grams (log-odds of
pooled n-gram counts of its two sides). A text gets one margin per bit, and the language whose codeword has the least
summed logistic loss against the margins wins; a small gap to the next one marks the result as ambiguous.

Fitting uses at most about FIT_ROWS distinct labelled texts of each language, drawn by a hash of the text (a documented bound; all
where there are fewer), so that no language is lost however often its texts repeat. A model has a row of features for each
language. Prediction reads every whole text, in stretches of bounded size.

Cases: text null or without a letter gives `und` with score 0, as does a model without any labelled row. Rows with
null lang or text teach nothing; rows of one language and text teach once. Ties go to the language first in text order, and are
ambiguous. Repeated rows, empty tables and extra columns need no rule: rows are independent.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, utf8, written

FIT_ROWS = 12_000
ORDERS = (1, 2, 3, 4)
#: Hash buckets of each order.
BUCKETS = 1 << 14
#: Margins are sharpened by this before the loss.
SHARPNESS = 6.0
#: Below this difference of probabilities a result is ambiguous.
CLEAR = 0.2
LETTER = re.compile(r"[^\W\d_]")
STRETCH = 1 << 18

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1. Up to 7 languages: every way to part them in two; beyond that 8 random bits a doubling, from a fixed seed, kept if rows and columns differ."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        return np.array([[1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in range(1, 2 ** (n - 1))] for i in range(n)], np.int8)
    bits = 8 * int(np.ceil(np.log2(n)))
    rng = np.random.default_rng(7)
    best, apart = None, -1
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        d = (bits - m.astype(int) @ m.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        if d.min() > apart and (np.abs(m.sum(0)) < n).all():
            best, apart = m, d.min()
    return best


def grams(data: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Feature of the n-gram that starts at each byte, for each order; the last feature (no n-gram) where it would leave the text."""
    data = _FOLD[data].astype(np.uint32)
    none, out = len(ORDERS) * BUCKETS, []
    for k, n in enumerate(ORDERS):
        h, size = np.zeros(len(data), np.uint32), len(data) - n + 1
        if size > 0:
            acc = np.zeros(size, np.uint32)
            for i in range(n):
                acc = acc * np.uint32(0x01000193) + data[i : i + size]
            acc *= np.uint32(0x9E3779B1)
            h = np.full(len(data), none, np.int32)
            h[:size] = np.where(doc[:size] == doc[n - 1 :], (acc >> np.uint32(18)).astype(np.int32) + k * BUCKETS, none)
        else:
            h = np.full(len(data), none, np.int32)
        out.append(h)
    return out


def stretches(ends: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Stretches of bytes that overlap by what an n-gram needs, with the text of each byte."""
    total, out = int(ends[-1]), []
    for lo in range(0, total, STRETCH):
        hi = min(total, lo + STRETCH + max(ORDERS) - 1)
        out.append((lo, min(total, lo + STRETCH), np.searchsorted(ends, np.arange(lo, hi), "right") - 1))
    return out


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict:
    """The model, from labelled rows: languages, codewords, weights of each feature and bit."""
    rows = pick(train, lang_col, text_col).toDF("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("lang", F.col("lang").cast("string"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    # A written table: its size is known when the join is planned, so the texts are not dealt out by language for it.
    there = written(hashed.select("lang", "hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    some = hashed.join(there, "lang").filter(F.pmod("hash", F.lit(1_000_003)) < F.lit(1_000_003.0 * fit_rows) / F.col("n"))
    drawn = some.groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")
    size = len(ORDERS) * BUCKETS + 1

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, ends = utf8(batch.column(1))
            for lo, hi, doc in stretches(ends):
                for f in grams(data[lo : lo + len(doc)], doc):
                    f, d = f[: hi - lo], doc[: hi - lo]
                    cuts = np.flatnonzero(np.diff(d)) + 1
                    for a, b in zip(np.append(0, cuts), np.append(cuts, len(f))):
                        lang = langs[d[a]]
                        sums.setdefault(lang, np.zeros(size, np.int64))
                        sums[lang] += np.bincount(f[a:b], minlength=size)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "sums"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                out += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([out.tobytes()], pa.binary())], names=["lang", "sums"])

    counts = {r.lang: np.frombuffer(bytes(r.sums), np.int64).astype(float) for r in drawn.mapInArrow(count, "lang string, sums binary").groupBy("lang").applyInArrow(total, "lang string, sums binary").collect()}
    if not counts:
        return {"langs": [], "codes": np.ones((0, 1)), "weights": np.zeros((size, 1), np.float32)}
    langs = sorted(counts)
    codes = codewords(len(langs))
    weights = np.zeros((size, codes.shape[1]), np.float32)
    if len(langs) > 1:
        # Each language weighs alike, whatever its number of rows.
        rates = np.stack([counts[x] / max(1.0, counts[x][:-1].sum()) for x in langs])
        for b in range(codes.shape[1]):
            for k in range(len(ORDERS)):
                at = slice(k * BUCKETS, (k + 1) * BUCKETS)
                up, down = (rates[codes[:, b] == s][:, at].mean(0) + 1e-7 for s in (1, -1))
                weights[at, b] = np.log(up / up.sum()) - np.log(down / down.sum())
    return {"langs": langs, "codes": codes, "weights": weights}


def margins(data: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's n-grams for each bit."""
    n = len(ends) - 1
    out, count = np.zeros((n, weights.shape[1])), np.zeros(n)
    for lo, hi, doc in stretches(ends):
        for f in grams(data[lo : lo + len(doc)], doc):
            f, d = f[: hi - lo], doc[: hi - lo]
            cuts = np.append(0, np.flatnonzero(np.diff(d)) + 1)
            out[d[cuts]] += np.add.reduceat(weights[f], cuts, axis=0)
            count[d[cuts]] += np.add.reduceat((f < len(weights) - 1).astype(float), cuts)
    return out / np.maximum(1.0, count)[:, None]


def decode(model: dict, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language of each row of margins, its probability, and whether the next one is close."""
    z = model["codes"][None, :, :] * (SHARPNESS * m[:, None, :])
    loss = np.logaddexp(0.0, -z).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(p, axis=1)
    gap = top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0.0)
    return best, top[:, -1], gap < CLEAR


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred string, score double (0 to 1), ambiguous boolean, of every whole text."""
    docs = pick(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x features: bounded by BUCKETS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        texts = batch.column(1).to_pylist()
        usable = np.array([bool(t and LETTER.search(t)) for t in texts]) & bool(model["langs"])
        langs, score, unsure = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if usable.any():
            best, p, close = decode(model, margins(*utf8(batch.column(1)), model["weights"]))
            langs[usable] = np.array(model["langs"], object)[best][usable]
            score[usable], unsure[usable] = p[usable], close[usable]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(unsure)], names=["id", "lang_pred", "score", "ambiguous"])

    return map_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def language_id(docs: DataFrame, learn: Column, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fit on the rows that `learn` keeps, predict all; held_out is a column made of the id alone."""
    model = fit(docs.filter(learn), lang_col, text_col, fit_rows)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out)
