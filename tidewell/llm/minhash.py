"""Near-duplicates by min-max hashing.

A text's set holds its distinct five-word shingles as 64-bit hashes. Every permutation gives two signature values, its
minimum and its maximum over the set, so PERMUTATIONS hash evaluations make 2 * PERMUTATIONS values with the
collision probability of plain MinHash and less variance. ROWS values of one kind make a band; texts that share a band
are candidates. With 40 bands of 4, a pair of similarity 0.75 is missed with probability 2.5e-7.

Equal sets are one class from the start. Within a band's bucket no list of all pairs is made: one member leads, the
others are confirmed against it on the full sets, and what is confirmed becomes one component. Of a bucket that is still in
several components, members outside its largest one are held against the others by exact filters inside the join:
sizes, and bitmaps of the sets (each bit in which two differ is a shingle that only one of them has), so that only
pairs near the threshold come out, each from the first bucket that it shares, and are confirmed. Where even that would be much work, other leaders have a try.
Members of buckets that are still too much for a task go through an exact prefix filter instead: similar sets share one
of their rarest shingles (a quarter of the set and one); texts that share such a shingle are dealt out in blocks. So a bucket's
pairs of different components are all dealt with, whatever its size.

Cases: null texts and texts without words have empty sets, n_shingles 0, and are linked with nothing, nor with
each other. A text of fewer than five words has one shingle, all its words. Rows without id have no component and
are kept. Ids count as unique: rows that share one each get the component of their own text. Empty tables give empty
results; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, pick, released, utf8, written
from .components import connected_components
from .words import bounds, hashes, lowered, mix, windows

SHINGLE = 5
PERMUTATIONS = 80
ROWS = 4
#: Rounds of leaders before the prefix filter takes over.
LEADERS = 3
#: Left-over comparisons for each candidate text (a few machine instructions each) that are made without a further round.
FEW = 2000
#: Comparisons that one bucket may bring to a task, and texts of a block of those that share a rare shingle.
BUCKET_WORK = 10_000_000
BLOCK = 1000
#: 64-bit words of a set's bitmap.
BITMAP = 32


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, ends = utf8(column)
    data = lowered(data)
    starts, stops, firsts = bounds(data, ends, "spaced")
    h = hashes(data, starts, stops)
    shingles, at = windows(h, firsts, size)
    cuts = np.searchsorted(at, firsts)
    out = []
    for i in range(len(firsts) - 1):
        n = firsts[i + 1] - firsts[i]
        if n >= size:
            out.append(np.unique(shingles[cuts[i] : cuts[i + 1]]))
        elif n:
            acc = np.array([n], np.uint64)
            for x in h[firsts[i] : firsts[i + 1]]:
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(n))
            out.append(acc)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], permutations: int = PERMUTATIONS, seed: int = 11) -> np.ndarray:
    """Minima and then maxima of each set under each permutation: one row for each set that is not empty."""
    sets = [s for s in sets if len(s)]
    if not sets:
        return np.zeros((0, 2 * permutations), np.uint64)
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, permutations, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, permutations, np.uint64)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    lo = 0
    while lo < len(sets):  # some sets at a time, so that what is hashed stays in the cache
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= 1 << 15):
            n += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        at = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        for i in range(permutations):
            h = (x ^ b[i]) * a[i]
            h ^= h >> np.uint64(32)
            h *= a[i]
            out[lo:hi, i] = np.minimum.reduceat(h, at)
            out[lo:hi, permutations + i] = np.maximum.reduceat(h, at)
        lo = hi
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, digest (of the whole set; null if empty), bands: one row for each row."""
    docs = pick(docs, id_col, text_col)
    n_bands = 2 * PERMUTATIONS // ROWS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1))
        values = signatures(sets)
        bands = np.zeros((len(values), n_bands), np.uint64)
        for r in range(ROWS):
            bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS])
        bands += np.arange(n_bands, dtype=np.uint64)  # equal values in different bands are different keys
        full = np.array([len(s) > 0 for s in sets], bool)
        ends = np.cumsum(np.concatenate([[0], np.where(full, n_bands, 0)])).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(mix(bands).view(np.int64).ravel())),
            ],
            names=["id", "n_shingles", "digest", "bands"],
        )

    return map_arrow(docs, run, f"id {docs.schema[0].dataType.simpleString()}, n_shingles long, digest binary, bands array<bigint>")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union. texts: id, text."""
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    kind = both.schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        leads = batch.column(2).dictionary_encode()  # a leader's text is worked on once
        left, of, right = shingle_sets(leads.dictionary), leads.indices.to_numpy(), shingle_sets(batch.column(3))
        good = []
        for i, y in zip(of, right):
            x = left[i]
            small, large = min(len(x), len(y)), max(len(x), len(y))
            if small and 100 * small >= percent * large:
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            else:
                good.append(False)
        return batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return map_arrow(both, run, f"a {kind}, b {kind}")


def bitmaps(texts: DataFrame) -> DataFrame:
    """id, b0 .. : a bitmap of each text's set."""
    kind = texts.select("id").schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.zeros((batch.num_rows, BITMAP * 64), bool)
        for row, s in zip(bits, shingle_sets(batch.column(1))):
            row[(s % np.uint64(BITMAP * 64)).astype(np.int64)] = True
        words = np.packbits(bits, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(BITMAP)]], names=["id", *[f"b{i}" for i in range(BITMAP)]])

    return map_arrow(texts.select("id", "text"), run, ", ".join([f"id {kind}", *[f"b{i} long" for i in range(BITMAP)]]))


def may_reach(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles with bitmaps x and y can meet the threshold.

    Bits that differ are at most the shingles that only one set has, d; similarity is (n + m - d) / (n + m + d).
    """
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def rare_pairs(rows: DataFrame, texts: DataFrame, bits: DataFrame, percent: int = 75) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles: an exact filter for the similarity. rows: rep, component."""
    have = rows.join(texts, rows.rep == texts.id).select("rep", "component", "text")
    kind, ckind = have.schema[0].dataType.simpleString(), have.schema[1].dataType.simpleString()

    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2))
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        all_of = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.array([len(s) for s in sets], np.int64)[at]), pa.array(all_of.view(np.int64))], names=["rep", "component", "n", "shingle"])

    shingles = map_arrow(have, explode, f"rep {kind}, component {ckind}, n long, shingle long")
    shingles = written(shingles, "shingles")
    counts = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    ranked = shingles.join(counts, "shingle")
    # A shingle's place in the rarest-first order of its text.
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle"))
    prefix = ranked.withColumn("place", place).filter((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("lo") < F.col("hi"))).select("rep", "component", "n", "shingle", "place")
    prefix = written(prefix, "prefix")
    blocks = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("shingle", F.ceil(F.col("texts") / BLOCK).alias("blocks"))
    prefix = prefix.join(blocks, "shingle")
    # Each block of a shingle's texts meets all of them in a task of its own.
    x = prefix.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("x")
    y = prefix.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).alias("y")
    # Length and position: what is left of both sets after this shingle must allow the overlap that is needed.
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    joined = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + F.least("x.place", "y.place") >= need))
    pairs = joined.select(F.col("x.rep").alias("a"), F.col("x.n").alias("n_a"), F.col("y.rep").alias("b"), F.col("y.n").alias("n_b")).distinct()
    pairs = pairs.join(bits.alias("x"), F.col("a") == F.col("x.id")).join(bits.alias("y"), F.col("b") == F.col("y.id"))
    return pairs.filter(may_reach(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, leaders: int = LEADERS) -> DataFrame:
    """id_col, n_shingles long, component_id (least id reachable), kept boolean: one row for each row."""
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    sketches = written(sketch(docs, "id", "text"), "sketches")
    named = sketches.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = named.groupBy("digest").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min("n_shingles").alias("n"))
    classes = written(classes, "classes")
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    buckets = written(rows.join(shared, "key"), "buckets")
    texts = written(docs.join(buckets.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").filter(F.col("text").isNotNull()).dropDuplicates(["id"]), "texts")
    bits = written(bitmaps(texts), "bitmaps")
    links = component = None
    done = [buckets, texts, bits]
    n_reps = texts.count()
    for turn in range(leaders + 1):
        if not n_reps:
            break
        here = buckets.withColumn("component", F.col("rep")) if component is None else buckets.join(component, buckets.rep == component.node, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
        last = False
        if turn:
            sizes = here.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
            mixed = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("members"), F.max_by("component", F.struct("size", F.xxhash64("component"))).alias("major"), F.max("size").alias("most")).filter("parts > 1")
            mixed = written(mixed.withColumn("work", (F.col("members") - F.col("most")).cast("double") * F.col("members")), "mixed")
            done.append(mixed)
            small = F.col("work") <= BUCKET_WORK
            parts, work, small_work, large = mixed.agg(F.count(F.lit(1)), F.sum("work"), F.coalesce(F.sum(F.when(small, F.col("work"))), F.lit(0.0)), F.count(F.when(~small, F.lit(1)))).first()
            if not parts:
                break
            here = here.join(mixed.select("key", "major", small.alias("small")), "key")
            last = work <= FEW * n_reps or turn == leaders
        if last:
            few = small_work <= FEW * n_reps
            own = bits.join(classes.select(F.col("rep").alias("id"), "bands"), "id")
            pairs = None
            if few:
                near = written(here.filter("small").join(own, F.col("rep") == own.id).drop("id"), "here")
                done.append(near)
                x, y = near.filter("component <> major").alias("x"), near.alias("y")
                pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & may_reach(F.col("x.n"), F.col("y.n"), percent) & (F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key"))).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
            if large or not few:
                # A pair whose first bucket is a large one comes out here.
                rare = rare_pairs((here.filter("NOT small") if few else here).select("rep", "component").distinct(), texts, bits, percent)
                pairs = rare if pairs is None else pairs.unionByName(rare)
            pairs = pairs.distinct()
        else:
            # One order of leaders for all buckets: a group of near copies has the same leader in most of them.
            lead = here.groupBy("key").agg(F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep", F.lit(turn))).alias("lead"))
            pairs = here.join(lead, "key").filter((F.col("component") != F.col("lead.component")) & (100 * F.least("n", "lead.n") >= percent * F.greatest("n", "lead.n"))).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), F.col("lead.n").alias("n_a"), F.col("n").alias("n_b")).distinct()
            pairs = pairs.join(bits.alias("x"), F.col("a") == F.col("x.id")).join(bits.alias("y"), F.col("b") == F.col("y.id")).filter(may_reach(F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
        found = written(confirm(pairs, texts, percent), "links")
        links = found if links is None else links.unionByName(found)
        done += [found, component]
        component = written(connected_components(links), "components")
        if last:
            break
    released(*done)
    out = sketches.join(classes.select("digest", "rep"), "digest", "left")
    if component is not None:
        out = out.join(component, out.rep == component.node, "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        out = out.withColumn("component", F.col("rep"))
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
