"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, strips accents, maps look-alike letters of other scripts to Latin ones, and undoes digit and symbol
substitutions inside words; what is left are words parted by single blanks. The lexicon's entries are word beginnings
(` lowei`) or whole words (` idiot `), found as those that labelled toxic texts have far more often than the others. An
entry is kept in its longest form that covers the same texts, so it is no wider than what was seen. Phrases around
an entry that occur in texts labelled clean are exceptions: a match inside one does not count. The sum of
weights, as such and by length, goes through a logistic curve fitted on the same labelled rows.

Fitting uses at most about FIT_ROWS distinct labelled texts, drawn by a hash (a documented bound; all where there are fewer), and of
near copies one. The lexicon has no other bound than that: whatever entries and exceptions those rows bear out. Entries and
exceptions are counted and chosen in tables; only chosen ones reach the driver. Scoring reads every whole text, in a time that
grows with its length; language, source and id are no inputs.

Cases: null and empty texts have no matches and get the curve's value at 0. Without labelled rows of both kinds the lexicon is
empty and the score is the share of toxic rows (0 without rows). Repeated labels of an id count once; labels of one id that
contradict each other both count. Of matches that start alike the heaviest counts, of equal ones the longest. Repeated rows,
empty tables and extra columns need no rule.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pick, released, written
from .minhash import shingle_sets, signatures

FIT_ROWS = 40_000
#: Toxic rows that an entry must have, near copies counted once.
LEAST_ROWS = 5
#: Natural log of how much more often toxic rows must have an entry.
LEAST_ODDS = 2.5
#: Letters of word beginnings; whole words may be of any length.
PREFIX = range(4, 10)
#: An entry's extension replaces it if it covers this share of its rows.
SAME = 0.97
#: Permutations by which near copies are told, how many of them pair rows, and how many of twice their number must agree.
COPY_HASHES, COPY_KEYS, COPY_AGREES = 8, 3, 12

# Fixed look-alikes: letters of other scripts and what they are read as.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһӏԛԝвкмнт", "aeopcyxijsdhlqwbkmht")) | dict(zip("αβεικνορτυχωηγ", "abeikvoptuxwny")) | dict(zip("ıłøđħ", "ilodh"))
# Fixed substitutions of letters by digits and symbols.
SUBSTITUTE = dict(zip("0134578@$!|", "oieastbasii"))
SWAPPED = re.compile(r"(?<=[^\W\d_])[0134578@$!|]+(?=[^\W\d_])|(?<![^\W_])[0134578@$!|]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?![^\W_])")
WORD = re.compile(r"[^\W\d_]+")


class _Folds(dict):
    def __missing__(self, c: int) -> str:
        s = unicodedata.normalize("NFKD", chr(c))
        s = "".join(LOOK_ALIKE.get(x, x) for x in s if not unicodedata.combining(x)).lower()
        self[c] = "".join(LOOK_ALIKE.get(x, x) for x in s) if unicodedata.category(chr(c)) not in ("Cf", "Mn") else ""
        return self[c]


_folds = _Folds()


def fold(text: str) -> str:
    """Words of the folded text, each between single blanks."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_folds)
    text = SWAPPED.sub(lambda m: "".join(SUBSTITUTE[c] for c in m.group()), text)
    return " " + " ".join(WORD.findall(text)) + " "


def beginnings(folded: str) -> set[str]:
    """Candidate entries of a text: beginnings of words, and whole words."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIX if n <= len(w))
    return out


def automaton(model: dict) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for entry, weight in model["weights"].items():
        a.add_word(entry, (len(entry), weight, entry))
    for phrase in model["exceptions"]:
        a.add_word(phrase, (len(phrase), 0.0, None))
    if len(a):
        a.make_automaton()
    return a


def hits(folded: str, a: ahocorasick.Automaton) -> list[tuple[int, int, float, str]]:
    """Start, end, weight and entry of matches outside exceptions; of matches that start alike the heaviest."""
    best: dict[int, tuple[int, int, float, str]] = {}
    free: list[tuple[int, int]] = []
    if not len(a):
        return []
    for end, (size, weight, entry) in a.iter(folded):
        start = end - size + 1
        if entry is None:
            free.append((start, end))
        elif start not in best or best[start][2] <= weight:
            best[start] = (start, end, weight, entry)
    if not free:
        return list(best.values())
    # By start, with the farthest end so far: an exception that covers a match starts no later and ends no sooner.
    free.sort()
    starts, ends = [s for s, _ in free], list(accumulate((e for _, e in free), max))
    covered = lambda s, e: (k := bisect_right(starts, s)) > 0 and ends[k - 1] >= e
    return [h for h in best.values() if not covered(h[0], h[1])]


def phrases(folded: str, found: list[tuple[int, int, float, str]]) -> set[str]:
    """Each match's word with the word before it, and with the word after it."""
    out = set()
    for start, _, _, _ in found:
        stop = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start) if start else -1
        after = folded.find(" ", stop + 1)
        if before >= 0:
            out.add(folded[before : stop + 1])
        if after >= 0:
            out.add(folded[start : after + 1])
    return out


def features(folded: str, found: list) -> tuple[float, float]:
    weight = sum(h[2] for h in found)
    words = folded.count(" ") - 1
    return float(np.log1p(weight)), float(np.log1p(100 * weight / max(20, words)))


def counted(rows: DataFrame, terms_of) -> DataFrame:
    """term, toxic, clean: rows of folded text and label that have each term. Terms are summed in each task before they are shuffled."""

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for folded, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for t in terms_of(folded):
                    sums.setdefault(t, [0, 0])[1 - label] += 1
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *[pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1)]], names=["term", "toxic", "clean"])

    return rows.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(terms: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries: terms that toxic rows have far more often, in their longest form that covers the same rows.

    If terms were found in toxic and clean rows alike, one of them would have the evidence that is asked for in about one fit of seven.
    """
    least = 2.0 + float(np.log(max(1, terms.count())))
    rate, seen = n_toxic / (n_toxic + n_clean), F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    evidence = F.col("toxic") * F.log(F.col("toxic") / seen / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / seen / (1 - rate))).otherwise(0.0)
    strong = terms.withColumn("odds", odds).filter((F.col("odds") >= LEAST_ODDS) & (evidence >= least))
    widest = terms.filter(F.length("term") > PREFIX[0] + 1).groupBy(F.expr("left(term, length(term) - 1)").alias("term")).agg(F.max("toxic").alias("widest"))
    closed = {r.term: r.odds for r in strong.join(widest, "term", "left").filter(F.coalesce("widest", F.lit(0)) < SAME * F.col("toxic")).select("term", "odds").collect()}
    return {t: closed[t] for t in sorted(closed) if not any(t[:k] in closed and closed[t[:k]] >= closed[t] - 1.0 for k in range(2, len(t)))}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve, the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """text and label of at most about fit_rows labelled ids, drawn by a hash of the id, as a table in the shared folder.

    The draw is made on the labels, which are small, so the texts need no shuffle: the ids go to the texts where their number, counted
    after the draw, is as small as it should be.
    """
    known = pick(labels, id_col, label_col).toDF("id", "label").filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    n = known.count()
    drawn = written(known if n <= fit_rows else known.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(1_000_003.0 * fit_rows / n)), "drawn")
    there = drawn.count()
    texts = pick(docs, id_col, text_col).toDF("id", "text").filter(F.col("text").isNotNull())
    out = written(texts.join(F.broadcast(drawn) if there <= 2 * fit_rows else drawn, "id").select("text", "label"), "labelled")
    released(drawn)
    return out


def one_of_copies(rows: DataFrame) -> DataFrame:
    """Folded text and label, of near copies with one label a single one: they would make their own words look telling.

    A row goes if most hash minima and maxima agree with those of the first row (by a hash of the text) that shares one of its first
    minima; as that one comes before it, the first of all copies stays. Texts without words are copies of each other.
    """

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(0))
        values = np.zeros((len(sets), 2 * COPY_HASHES), np.uint64)
        values[[i for i, s in enumerate(sets) if len(s)]] = signatures(sets, COPY_HASHES)
        ends = np.arange(len(sets) + 1, dtype=np.int32) * 2 * COPY_HASHES
        return pa.RecordBatch.from_arrays([pa.array([fold(t) for t in batch.column(0).to_pylist()], pa.string()), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64).ravel()))], names=["text", "label", "rank", "marks"])

    signed = written(map_arrow(rows.select("text", "label").distinct().withColumn("rank", F.xxhash64("text")), sign, "text string, label int, rank long, marks array<bigint>"), "signed")
    gone = None
    for k in range(COPY_KEYS):
        own = signed.select("label", "rank", "marks", F.get("marks", F.lit(k)).alias("key"))
        first = own.groupBy("label", "key").agg(F.min_by(F.struct("rank", "marks"), "rank").alias("first"))
        agree = F.aggregate(F.zip_with("marks", "first.marks", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, b: a + b)
        more = own.join(first, ["label", "key"]).filter((F.col("rank") > F.col("first.rank")) & (agree >= COPY_AGREES)).select("label", "rank")
        gone = more if gone is None else gone.unionByName(more)
    out = written(signed.join(gone, ["label", "rank"], "left_anti").select("text", "label"), "distinct")
    released(signed)
    return out


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", fit_rows: int = FIT_ROWS) -> dict:
    """Lexicon with weights, exceptions, and the curve, from rows of text and 0/1 label."""
    rows = pick(labelled, text_col, label_col).toDF("text", "label").filter(F.col("text").isNotNull() & F.col("label").isin(0, 1)).withColumn("label", F.col("label").cast("int"))
    n, n_toxic, n_texts = rows.agg(F.count(F.lit(1)), F.sum("label"), F.count_distinct(F.xxhash64("text"))).first()
    n_toxic = n_toxic or 0
    model: dict = {"weights": {}, "exceptions": [], "curve": np.array([np.log((n_toxic + 1e-9) / (n - n_toxic + 1e-9)) if n else -50.0, 0.0, 0.0])}
    if not n_toxic or n_toxic == n:
        return model
    if n_texts > 2 * fit_rows:  # not drawn yet
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(1_000_003.0 * fit_rows / n_texts))
    rows = one_of_copies(rows)
    n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    n_clean = n - n_toxic
    if not n_toxic or not n_clean:
        return model
    terms = written(counted(rows, beginnings).filter(F.col("toxic") >= LEAST_ROWS), "terms")
    model["weights"] = telling(terms, n_toxic, n_clean)
    plain = automaton(model)
    around = counted(rows, lambda folded: phrases(folded, hits(folded, plain))).filter((F.col("clean") >= 3) & (F.col("clean") * n_toxic >= 9 * F.col("toxic") * n_clean))
    model["exceptions"] = sorted(r.term for r in around.select("term").collect())

    def measure(batches):
        a = automaton(model)
        for batch in batches:
            x = [features(f, hits(f, a)) for f in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column(1)], names=["a", "b", "label"])

    # One row for each distinct pair of features: what reaches the driver is bounded by fit_rows.
    points = rows.mapInArrow(measure, "a double, b double, label int").groupBy(F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), "label").count().collect()
    x, y = np.repeat(np.array([(p.a, p.b) for p in points]), [p["count"] for p in points], axis=0), np.repeat([p.label for p in points], [p["count"] for p in points])
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    model["curve"] = logistic(x[order], y[order])
    released(terms, rows)
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score double, predicted int, n_matches long, matched string (entries, comma-joined, sorted) of every whole text."""
    docs = pick(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as the rows are that it was fitted on

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value  # the worker's own copy
        if "automaton" not in model:
            model["automaton"] = automaton(model)
        a, w = model["automaton"], model["curve"]
        found = [(f, hits(f, a)) for f in (fold(t or "") for t in batch.column(1).to_pylist())]
        x = np.array([features(f, h) for f, h in found]).reshape(-1, 2)
        p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -50, 50)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(h) for _, h in found], pa.int64()), pa.array([",".join(sorted({e[3].strip() for e in h})) for _, h in found], pa.string())], names=["id", "score", "predicted", "n_matches", "matched"])

    return map_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, score double, predicted int, n_matches long, matched string").withColumnRenamed("id", id_col)
