"""Benchmark decontamination with suffix arrays of the training texts.

Each Arrow batch of documents is a shard. Its words become ids in the benchmark's vocabulary, and a sparse suffix
array sorts those word positions at which a benchmark passage may start (the next few words occur so in the
benchmark). Every benchmark suffix is looked up by binary search; the range found gives all places, and ranges that
follow on are joined to longest verbatim matches, which are then compared word by word.

The benchmark goes to the workers in blocks of about BLOCK_BYTES. Where it is larger than one block, a bitmap of all its windows
(of bounded size, with false alarms and no misses) first parts the documents that may hold one from the rest, in one pass. Those
few are written, the blocks are held against them one after the other (the driver holds one block at a time), and covered words are
united per document. A passage that many items share is one window here: items are listed once a document, not once a place.

Cases: null and empty texts have no words and hit nothing; an item without words is never found; an item shorter
than the window is one window. Equal items, also under one id, count as the ids they have; item ids may be null (they
are then ignored). Repeated document rows each get their row; documents and benchmark may be empty; other columns
play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, map_arrow, pick, tidied, utf8, written
from .words import bounds, hashes, lowered, mix, ragged, windows

WINDOW = 13
#: Text bytes of benchmark items that workers hold at a time.
BLOCK_BYTES = 32_000_000
#: Words that must occur in a row in the benchmark for a document position to enter the suffix array.
GRAM = 4
#: Bits at most in the bitmap of windows, in a chunk of it, and for each window.
BITMAP_BITS = 1 << 28
CHUNK_BITS = 1 << 20
PROBES = 6
OUTPUTS = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")


class Items:
    """A block of benchmark items: vocabulary, word ids, distinct windows in order and the items that have each."""

    def __init__(self, ids: list[str], texts: list[str], width: int = WINDOW):
        self.names = ids
        data, ends = utf8(pa.array(texts, pa.string()))
        data = lowered(data)
        starts, stops, self.firsts = bounds(data, ends, "plain")
        h = hashes(data, starts, stops)
        self.words = [data[s:e].tobytes() for s, e in zip(starts, stops)]
        self.vocabulary, at, self.word_ids = np.unique(h, return_index=True, return_inverse=True)
        self.spelt = [self.words[i] for i in at]
        self.exact: dict[bytes, int] | None = None
        if any(w != self.spelt[i] for w, i in zip(self.words, self.word_ids.tolist())):  # two words of one hash
            self.exact = {w: i for i, w in enumerate(sorted(set(self.words)))}
            self.spelt = list(self.exact)
            self.word_ids = np.array([self.exact[w] for w in self.words], np.int64)
        sizes = np.diff(self.firsts)
        self.width = width
        self.sizes = np.minimum(sizes, width)  # of each item's windows
        count = np.where(sizes > 0, np.maximum(1, sizes - width + 1), 0)
        self.item = np.repeat(np.arange(len(ids)), count)
        self.at = ragged(self.firsts[:-1], count)  # the word at which each window starts
        self.gram = int(min(GRAM, self.sizes[self.sizes > 0].min(initial=GRAM)))
        grams = self.at[:, None] + np.arange(self.gram)
        self.grams = np.unique(self.keys(self.word_ids[grams])) if len(self.at) else np.zeros(0, np.uint64)
        # Equal windows are one, with a list of items; lists that are equal are one as well.
        padded = np.concatenate([self.word_ids + 1, np.zeros(width, np.int64)])
        rows = np.where(np.arange(width) < self.sizes[self.item][:, None], padded[self.at[:, None] + np.arange(width)], 0)
        keys = np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * width}").ravel()
        _, self.first, self.window = np.unique(keys, return_index=True, return_inverse=True)
        order = np.lexsort((self.item, self.window))
        cuts = np.searchsorted(self.window[order], np.arange(len(self.first) + 1))
        lists: dict[bytes, int] = {}
        self.lists: list[np.ndarray] = []
        self.list_of = np.zeros(len(self.first), np.int64)
        for u, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            own = np.unique(self.item[order[a:b]])
            self.list_of[u] = lists.setdefault(own.tobytes(), len(lists))
            if len(lists) > len(self.lists):
                self.lists.append(own)

    @staticmethod
    def keys(ids: np.ndarray) -> np.ndarray:
        """A row of word ids as one number (equal rows, equal numbers)."""
        out = np.zeros(len(ids), np.uint64)
        for i in range(ids.shape[1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[:, i].astype(np.uint64) + np.uint64(1)
        return out


class Shard:
    """The documents of a batch with their sparse suffix array over word ids."""

    def __init__(self, column: pa.Array, items: Items):
        self.items = items
        data, ends = utf8(column)
        self.data = lowered(data)
        self.starts, self.stops, self.firsts = bounds(self.data, ends, "plain")
        n = len(self.starts)
        h = hashes(self.data, self.starts, self.stops)
        if len(items.vocabulary):
            place = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
            ids = np.where(items.vocabulary[place] == h, place, -1)
            if items.exact is not None:
                ids = np.array([items.exact.get(self.data[a:b].tobytes(), -1) for a, b in zip(self.starts, self.stops)], np.int64)
        else:
            ids = np.full(n, -1)
        self.doc = np.repeat(np.arange(len(ends) - 1), np.diff(self.firsts))
        self.ids = ids = np.concatenate([ids, np.full(items.width, -1)])
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        span = np.arange(n)
        span = span[known[span + items.gram] - known[span] == items.gram]  # the next words are all in the vocabulary
        if len(span):
            near = Items.keys(ids[span[:, None] + np.arange(items.gram)])
            span = span[np.isin(near, items.grams)]
        rows = ids[span[:, None] + np.arange(items.width)] + 1
        inside = span[:, None] + np.arange(items.width) < self.firsts[1:][self.doc[span]][:, None] if len(span) else rows
        rows = np.where(inside, rows, 0)  # a suffix ends with its document
        order = np.lexsort(rows.T[::-1]) if len(span) else span
        self.suffix = span[order]
        self.sorted = np.ascontiguousarray(rows[order].astype(">u4")).view(f"S{4 * items.width}").ravel()

    def find(self) -> tuple[np.ndarray, np.ndarray]:
        """For every distinct benchmark window and place in the shard: the window and the word at which it starts. Hashes that agree are followed by a look at the words."""
        items = self.items
        if not len(self.suffix) or not len(items.at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, sizes = items.at[items.first], items.sizes[items.item[items.first]]
        padded = np.concatenate([items.word_ids + 1, np.zeros(items.width, np.int64)])
        rows = padded[at[:, None] + np.arange(items.width)]
        inside = np.arange(items.width) < sizes[:, None]
        key = lambda fill: np.ascontiguousarray(np.where(inside, rows, fill).astype(">u4")).view(f"S{4 * items.width}").ravel()
        lo = np.searchsorted(self.sorted, key(0), "left")
        hi = np.searchsorted(self.sorted, key(0xFFFFFFFF), "right")
        window, place = np.repeat(np.arange(len(lo)), hi - lo), self.suffix[ragged(lo, hi - lo)]
        if not len(place):
            return window, place
        wrong = np.zeros(len(self.starts) + 1, np.int64)
        for w in np.flatnonzero(self.covered(place, sizes[window])).tolist():
            wrong[w + 1] = self.data[self.starts[w] : self.stops[w]].tobytes() != items.spelt[self.ids[w]]
        wrong = np.cumsum(wrong)
        good = wrong[place + sizes[window]] == wrong[place]
        return window[good], place[good]

    def covered(self, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which words lie in one of the stretches."""
        cover = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + sizes, -1)
        return np.cumsum(cover[:-1]) > 0

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Of each document: the longest runs of covered words, and ids of the items whose windows occur."""
        items = self.items
        window, place = self.find()
        n = len(self.firsts) - 1
        runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        found: list[set[str]] = [set() for _ in range(n)]
        if not len(place):
            return runs, found
        cover = self.covered(place, items.sizes[items.item[items.first[window]]])
        edge = np.append(False, cover[1:] & cover[:-1] & (self.doc[1:] == self.doc[:-1]))
        heads = np.flatnonzero(cover & ~edge)
        tails = np.flatnonzero(cover & ~np.append(edge[1:], False)) + 1
        for d, a, b in zip(self.doc[heads].tolist(), heads.tolist(), tails.tolist()):
            runs[d].append((a - int(self.firsts[d]), b - int(self.firsts[d])))
        pairs = np.unique(self.doc[place] * len(items.lists) + items.list_of[window])
        for d, which in zip(*(x.tolist() for x in np.divmod(pairs, len(items.lists)))):
            found[d].update(items.names[i] for i in items.lists[which])
        return runs, found

    def matches(self) -> list[tuple[int, int, int, int, int]]:
        """Longest verbatim matches: document, item, start word in each, words."""
        items = self.items
        window, place = self.find()
        if not len(window):
            return []
        # Every place with every item that has its window.
        order = np.argsort(items.window, kind="stable")
        cuts = np.searchsorted(items.window[order], np.arange(len(items.first) + 1))
        count = np.diff(cuts)[window]
        each, place = order[ragged(cuts[window], count)], np.repeat(place, count)
        doc, item = self.doc[place], items.item[each]
        start = items.at[each] - items.firsts[item]
        diagonal = place - start
        order = np.lexsort((place, diagonal, item, doc))
        doc, item, start, place, diagonal, sizes = (x[order] for x in (doc, item, start, place, diagonal, items.sizes[item]))
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(doc)) - 1
        return [(int(doc[a]), int(item[a]), int(place[a] - self.firsts[doc[a]]), int(start[a]), int(place[b] - place[a] + sizes[b])) for a, b in zip(at, last)]


def named_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item as text, and text, of the items that have both; repeated rows once."""
    named = pick(benchmark, item_col, text_col).toDF("item", "text").filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    return named.select(F.col("item").cast("string").alias("item"), "text").distinct()


def n_blocks(named: DataFrame, block_bytes: int) -> int:
    return max(1, -(-int(named.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // block_bytes))


def block(named: DataFrame, k: int, n: int) -> tuple[tuple[str, str], ...]:
    """Block k of n, of bounded size."""
    rows = named if n == 1 else named.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return tuple(sorted((r.item, r.text) for r in rows.collect()))


def window_hashes(column: pa.Array, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of window, hashes of a batch's runs of so many words, and the text of each."""
    data, ends = utf8(column)
    data = lowered(data)
    starts, stops, firsts = bounds(data, ends, "plain")
    h = hashes(data, starts, stops)
    for k in sizes:
        found, at = windows(h, firsts, k)
        yield mix(found + np.uint64(k)), np.searchsorted(firsts, at, "right") - 1


def probe(h: np.ndarray, j: int, bits: int) -> np.ndarray:
    """The j-th bit of each hash."""
    return (mix(h + np.uint64(j)) & np.uint64(bits - 1)).astype(np.int64)


def window_bitmap(named: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """A bitmap of at most BITMAP_BITS in which every window of every item is marked, and the sizes of windows. It is put together chunk by chunk on the workers."""
    total = int(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    bits = min(BITMAP_BITS, max(CHUNK_BITS, 1 << (8 * total).bit_length()))

    named.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sizes = np.zeros(bits, bool), set()
        for batch in batches:
            data, ends = utf8(batch.column(1))
            n = np.minimum(np.diff(bounds(lowered(data), ends, "plain")[2]), width)
            for k in np.unique(n[n > 0]).tolist():
                sizes.add(k)
                of_size = batch.column(1).take(pa.array(np.flatnonzero(n == k)))
                for h, _ in window_hashes(of_size, [k]):
                    for j in range(PROBES):
                        marks[probe(h, j, bits)] = True
        for c in np.flatnonzero(marks.reshape(-1, CHUNK_BITS).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(marks[c * CHUNK_BITS : (c + 1) * CHUNK_BITS]).tobytes()], pa.binary())], names=["chunk", "marks"])
        for k in sizes:
            yield pa.RecordBatch.from_arrays([pa.array([-k], pa.int64()), pa.array([b""], pa.binary())], names=["chunk", "marks"])

    def unite(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = b""
        for batch in batches:
            for x in batch.column("marks").to_pylist():
                out = (np.frombuffer(out, np.uint8) | np.frombuffer(x, np.uint8)).tobytes() if out else x
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([out], pa.binary())], names=["chunk", "marks"])

    marks, sizes = np.zeros(bits // 8, np.uint8), []
    for r in named.mapInArrow(tidied(mark), "chunk long, marks binary").groupBy("chunk").applyInArrow(unite, "chunk long, marks binary").collect():
        if r.chunk < 0:
            sizes.append(-r.chunk)
        else:
            marks[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(bytes(r.marks), np.uint8)
    return marks, sorted(sizes)


def may_hold(column: pa.Array, marks: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Whether each text of a batch has a run of words that the bitmap takes for a window."""
    out = np.zeros(len(column), bool)
    for h, text in window_hashes(column, sizes):
        for j in range(PROBES):
            at = probe(h, j, 8 * len(marks))
            good = (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 != 0
            h, text = h[good], text[good]
        out[text] = True
    return out


_items: dict[tuple, Items] = {}


def _built(block: tuple, width: int) -> Items:
    """The block's index, kept for the worker's next batches."""
    key = (hash(block), width)
    if key not in _items:
        _items.clear()
        _items[key] = Items([i for i, _ in block], [t for _, t in block], width)
    return _items[key]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All longest verbatim matches of at least a window: id_col, item_id string, doc_start, item_start, n_words (words from 0)."""
    named = named_items(benchmark, item_col, text_col)
    n = n_blocks(named, block_bytes)
    docs = pick(docs, id_col, text_col)
    kind = docs.schema[0].dataType.simpleString()
    out = None
    for k in range(n):

        def run(batch: pa.RecordBatch, items: tuple = block(named, k, n)) -> pa.RecordBatch:
            built = _built(items, width)
            found = Shard(batch.column(1), built).matches()
            doc, item, start, at, size = (list(x) for x in zip(*found)) if found else ([], [], [], [], [])
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array([built.names[i] for i in item], pa.string()), *[pa.array(x, pa.int64()) for x in (start, at, size)]], names=["id", "item_id", "doc_start", "item_start", "n_words"])

        part = map_arrow(docs, run, f"id {kind}, item_id string, doc_start long, item_start long, n_words long")
        part = part if n == 1 else written(part, "matches")  # before the next block is fetched
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WINDOW, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hit words and items of every document: id_col, carry, and OUTPUTS: n_words, n_hit, n_items long, items string (ids sorted as text, comma-joined), items_sha256, contaminated."""
    named = named_items(benchmark, item_col, text_col)
    n = n_blocks(named, block_bytes)
    kept = pick(docs, id_col, text_col, *[c for c in carry if c not in (id_col, text_col)])
    own = [f for f in kept.schema.fields if f.name == id_col or f.name in carry]
    at = [kept.columns.index(f.name) for f in own]
    full = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema.fields))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in zip(at, own)] + ["n_words long, n_hit long, n_items long, items string, items_sha256 string, contaminated boolean"])

    def summed(batch: pa.RecordBatch, words: np.ndarray, covers: list, items: list) -> pa.RecordBatch:
        hit = []
        for spans in covers:
            total, until = 0, 0
            for s, e in sorted(spans):
                total += max(0, e - max(s, until))
                until = max(until, e)
            hit.append(total)
        joined = [",".join(sorted(x)) for x in items]
        columns = [
            pa.array(words, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array(joined, pa.string()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
            pa.array([h > 0 and 20 * h >= int(w) for h, w in zip(hit, words)], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in at] + columns, names=[f"c{i}" for i in at] + list(OUTPUTS))

    def count_words(batch: pa.RecordBatch) -> np.ndarray:
        data, ends = utf8(batch.column(1))
        return np.diff(bounds(lowered(data), ends, "plain")[2])

    if n == 1:
        only = block(named, 0, 1)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            shard = Shard(batch.column(1), _built(only, width))
            return summed(batch, np.diff(shard.firsts), *shard.hits())

        return map_arrow(kept, run, schema).toDF(*[f.name for f in own], *OUTPUTS)
    named = written(named, "items")
    marks, sizes = window_bitmap(named, width)
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # at most BITMAP_BITS

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(batch.filter(pa.array(may_hold(batch.column(1), shared.value, sizes))).columns, names=[f"c{i}" for i in range(batch.num_columns)])

    def rest(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = batch.filter(pa.array(~may_hold(batch.column(1), shared.value, sizes)))
        return summed(batch, count_words(batch), [()] * batch.num_rows, [()] * batch.num_rows)

    maybe = written(map_arrow(kept, some, full).withColumn("row", F.monotonically_increasing_id()), "maybe")
    spans = None
    for k in range(n):

        def part(batch: pa.RecordBatch, items: tuple = block(named, k, n)) -> pa.RecordBatch:
            shard = Shard(batch.column(1), _built(items, width))
            covers, found = shard.hits()
            hit = [i for i, x in enumerate(covers) if x]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), pa.array([[{"s": s, "e": e} for s, e in covers[i]] for i in hit], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array([sorted(found[i]) for i in hit], pa.list_(pa.string()))], names=["row", "spans", "found"])

        more = written(map_arrow(maybe.select("row", "c1"), part, "row long, spans array<struct<s:bigint,e:bigint>>, found array<string>"), "spans")
        spans = more if spans is None else spans.unionByName(more)
    spans = spans.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    joined = maybe.join(spans, "row", "left").drop("row")

    def final(batch: pa.RecordBatch) -> pa.RecordBatch:
        covers = [[(x["s"], x["e"]) for x in v or ()] for v in batch.column(batch.num_columns - 2).to_pylist()]
        found = [set(v or ()) for v in batch.column(batch.num_columns - 1).to_pylist()]
        return summed(batch, count_words(batch), covers, found)

    return map_arrow(joined, final, schema).unionByName(map_arrow(kept, rest, schema)).toDF(*[f.name for f in own], *OUTPUTS)
