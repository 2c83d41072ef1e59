"""Removal of repeated passages with an enhanced suffix array and its common-prefix intervals.

A passage of MIN_BYTES or more that also starts in a document with a smaller id is removed. Three steps follow each other, each
with its own shuffle of packed arrays; the texts are shuffled once, into parts of bounded size:

1. Every MIN_BYTES window is assigned the least hash of its GRAM-byte substrings. Equal windows have equal minima, so only
   windows whose minimum occurs in two documents can repeat. Each part sends its distinct minima; those seen twice come back.
2. Runs of windows with such a minimum are cut out as fragments (each part sends a fragment once, with its smallest id) and
   dealt out by the minimum. Where the fragments of a minimum differ, their suffixes of at least MIN_BYTES are sorted, common
   prefixes are taken of neighbours, and a stack scan walks the tree of common-prefix intervals. An interval whose suffixes
   are preceded by different bytes (or begin their fragment) is a maximal repeat; all its occurrences get its length and its smallest id.
3. Each part looks its fragments up and marks the bytes of every occurrence whose repeat also starts in a smaller id.

A stock phrase too short to repeat by itself can put one fragment of each document under one minimum. A minimum that HOT_PARTS parts
have, in many different fragments, is split: its fragments are cut again, by the least hash of substrings one byte shorter
than a window. Those pieces hold two windows at most, so that one such minimum has at most 256 x 256 different ones, however many
documents have the phrase; all of them go through the same suffix sort.

Windows that repeat lie inside a maximal repeat with the same occurrences, so the marked bytes are exactly those covered by
repeated windows. A fragment that very many documents share is one row from each part, however many they are.

Cases: null and empty texts have no bytes, nothing to remove and the digest of no bytes. Texts below MIN_BYTES never
match. Repeats inside one document, or between rows of one id, are not removed. Rows without id neither remove nor
lose anything. Ids are integers. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_text_bytes, map_arrow, pick, utf8
from .words import mix, powers, ragged

MIN_BYTES = 50
GRAM = 20
#: Text bytes in a part, and of a slice that is worked on at once.
PART_BYTES = 4_000_000
#: Parts at most while they are no larger than MOST_PART_BYTES.
PARTS, MOST_PART_BYTES = 1 << 20, 8_000_000
SLICE = 1 << 19
#: A minimum in so many parts, with so many different last bytes of its fragments' hashes, is split.
HOT_PARTS, HOT_KINDS = 256, 128
#: Bytes of text for each bucket of minima.
BUCKET_BYTES = 8_000_000
#: Suffixes sorted together, unless one minimum has more.
CHUNK = 1 << 16

_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=sums[1:])
    return sums


def spans_hash(sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """Hash of data[start : start + size]."""
    return mix((sums[starts + sizes] - sums[starts]) * powers(len(sums), _INVERSE, "down")[starts] + np.asarray(sizes, np.uint64))


def least_in_window(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def slices(ends: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges to work on: whole texts together, or pieces of a long one that overlap by length - 1. They depend on each text alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        lo, j = int(ends[i]), i
        while j < n and ends[j + 1] - lo <= SLICE:
            j += 1
        if j > i:
            yield lo, int(ends[j])
            i = j
        else:
            for at in range(lo, int(ends[i + 1]), SLICE):
                yield at, min(int(ends[i + 1]), at + SLICE + length - 1)
            i += 1


def runs(data: np.ndarray, ends: np.ndarray, length: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one minimum: text, first window, how many windows, minimum, hash of the run's bytes.

    How a text is cut into runs depends on that text alone. Runs are at most as long as a window has substrings; longer ones are cut.
    """
    width, parts = length - gram + 1, []
    for lo, hi in slices(ends, length):
        n = hi - lo - length + 1
        if n <= 0:
            continue
        piece = data[lo:hi]
        sums = prefix_sums(piece)
        minima = least_in_window(spans_hash(sums, np.arange(len(piece) - gram + 1), gram), width)
        text = np.searchsorted(ends, np.arange(lo, hi), "right") - 1
        inside = text[:n] == text[length - 1 : length - 1 + n]
        new = np.ones(n, bool)
        new[1:] = (minima[1:n] != minima[: n - 1]) | ~inside[:-1] | (text[1:n] != text[: n - 1])
        at = np.flatnonzero(inside & new)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True)) + 1
        size = stop - at
        if len(size) and size.max() > width:  # cut long runs
            pieces = -(-size // width)
            k = ragged(np.zeros(len(size), np.int64), pieces)
            at, size = np.repeat(at, pieces) + k * width, np.minimum(np.repeat(size, pieces) - k * width, width)
        parts.append((text[at], at + lo, size, minima[at], spans_hash(sums, at, size + length - 1)))
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_words(data: np.ndarray, starts: np.ndarray, left: np.ndarray, most: int) -> list[np.ndarray]:
    """The suffixes' bytes as big-endian 64-bit words, zero beyond their end."""
    padded = np.concatenate([data, np.zeros(most + 8, np.uint8)])
    out = []
    for j in range(0, most, 8):
        word = np.zeros(len(starts), np.uint64)
        for b in range(8):
            word = (word << np.uint64(8)) | np.where(j + b < left, padded[starts + j + b], 0).astype(np.uint64)
        out.append(word)
    return out


def common_prefixes(words: list[np.ndarray], left: np.ndarray) -> np.ndarray:
    """Bytes that each sorted suffix shares with the one before it (0 for the first)."""
    n = len(left)
    lcp, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    open_[:1] = False
    for w in words:
        diff = np.zeros(n, np.uint64)
        diff[1:] = w[1:] ^ w[:-1]
        equal = np.full(n, 8)
        for b in range(8):
            equal = np.where((diff >> np.uint64(8 * b)) & np.uint64(255) != 0, 7 - b, equal)
        lcp += np.where(open_, equal, 0)
        open_ &= equal == 8
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    return lcp


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats of at least `least` bytes: first and last place in the suffix array, length, smallest doc. Longer ones come before those they are nested in.

    before: the byte before each suffix, a negative number of its own where the fragment begins. One scan with a stack of open
    intervals; each carries what its suffixes are preceded by (one byte so far, or several) and their smallest doc.
    """
    out, stack, n = [], [], len(lcp)  # stack: length, first place, byte before (None: several), smallest doc
    high = lcp >= least
    edge = np.append(high, False)
    heads = np.flatnonzero(edge[1:] & ~edge[:-1])
    for head in heads:
        stop = head + 1
        while stop < n and high[stop]:
            stop += 1
        if not (before[head:stop] != before[head]).any():
            continue  # preceded by one byte everywhere: part of a longer repeat
        for i in range(head + 1, stop + 1):
            here = int(lcp[i]) if i < stop else 0
            first, byte, small = i - 1, int(before[i - 1]), int(doc[i - 1])
            while stack and stack[-1][0] > here:
                size, first, seen, least_doc = stack.pop()
                byte, small = (seen if seen == byte else None), min(least_doc, small)
                if byte is None:
                    out.append((first, i - 1, size, small))
            if here >= least:
                if stack and stack[-1][0] == here:
                    size, at, seen, least_doc = stack.pop()
                    stack.append((here, at, seen if seen == byte else None, min(least_doc, small)))
                else:
                    stack.append((here, first, byte, small))
        stack.clear()
    return out


def fragment_repeats(data: np.ndarray, ends: np.ndarray, group: np.ndarray, doc: np.ndarray, least: int = MIN_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of maximal repeats among distinct fragments sorted by group: fragment, offset, length, smallest doc of the repeat."""
    out: list[tuple[np.ndarray, ...]] = []
    sizes = np.diff(ends)
    count = sizes - least + 1
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    edges = np.append(edges, len(group))
    totals = np.concatenate([[0], np.cumsum(count)])
    g = 0
    while g < len(edges) - 1:
        h = g + 1
        while h < len(edges) - 1 and totals[edges[h + 1]] - totals[edges[g]] <= CHUNK:
            h += 1
        a, b = edges[g], edges[h]
        g = h
        frag = np.repeat(np.arange(a, b), count[a:b])
        offset = ragged(np.zeros(b - a, np.int64), count[a:b])
        starts = ends[frag] + offset - ends[a]
        left = sizes[frag] - offset
        piece = data[ends[a] : ends[b]]
        words = suffix_words(piece, starts, left, int(sizes[a:b].max()))
        order = np.lexsort((left, *words[::-1]))
        frag, offset, starts, left = frag[order], offset[order], starts[order], left[order]
        lcp = common_prefixes([w[order] for w in words], left)
        before = np.where(offset > 0, piece[np.maximum(starts - 1, 0)].astype(np.int64), -1 - np.arange(len(starts)))
        found = maximal_repeats(lcp, before, doc[frag], least)
        if found:
            # A place needs a shorter repeat only if that one starts in a smaller doc than all longer ones there.
            best, parts = np.full(len(frag), np.iinfo(np.int64).max), []
            for first, last, length, small in found:
                at = first + np.flatnonzero(best[first : last + 1] > small)
                if len(at):
                    best[at] = small
                    parts.append((frag[at], offset[at], np.full(len(at), length), np.full(len(at), small)))
            out += parts
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(at):
            yield int(bucket[at[0]]), at


def packed(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of integers and byte strings as a table."""
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [pa.binary() if n.startswith("b_") else pa.int64() for n in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def joined(table: pa.Table, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All of a column of packed arrays, and how many entries each row has."""
    blobs = table.column(name).to_pylist()
    sizes = np.array([len(x) for x in blobs], np.int64) // np.dtype(dtype).itemsize
    return np.frombuffer(b"".join(blobs), dtype), sizes


def packed_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The texts of a batch (id, text, part) as a compressed row for each part."""
    data, ends = utf8(batch.column(1))
    sizes, ids = np.diff(ends), batch.column(0)
    known, ids = ~ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    compressor = zstandard.ZstdCompressor(level=3)
    rows = [(p, known[i].tobytes(), ids[i].tobytes(), sizes[i].astype("<i8").tobytes(), compressor.compress(data[ragged(ends[i], sizes[i])].tobytes())) for p, i in by_bucket(batch.column(2).to_numpy())]
    return packed(rows, ["part", "b_known", "b_ids", "b_sizes", "b_text"]).combine_chunks().to_batches()[0]


def texts_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, ends, ids, and which rows have an id."""
    d = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join(d.decompress(x) for x in table.column("b_text").to_pylist()), np.uint8)
    return data, np.concatenate([[0], np.cumsum(joined(table, "b_sizes", "<i8")[0])]), joined(table, "b_ids", "<i8")[0], joined(table, "b_known", "?")[0]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """For each row: id_col, n_bytes, n_removed, n_spans long, spans (array of start and end byte), kept_sha256."""
    docs = pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    _, total = checked_text_bytes(docs, "text")
    n_parts, n_buckets = max(8, total // min(MOST_PART_BYTES, max(PART_BYTES, total // PARTS))), max(8, total // BUCKET_BYTES)
    docs = map_arrow(docs.withColumn("part", F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(n_parts))), packed_texts, "part long, b_known binary, b_ids binary, b_sizes binary, b_text binary")
    gram, long_gram = min(GRAM, min_bytes), max(1, min_bytes - 1)

    def pieces(data: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of the runs of a split minimum: run, first byte, windows, minimum, hash. Stretches of runs bound what is cut at a time."""
        for lo in range(0, len(start), 1 << 12):
            first, sizes = start[lo : lo + (1 << 12)], count[lo : lo + (1 << 12)] + min_bytes - 1
            cut = np.concatenate([[0], np.cumsum(sizes)])
            run, begin, n, minimum, hashed = runs(data[ragged(first, sizes)], cut, min_bytes, long_gram)
            yield run + lo, begin - cut[run] + first[run], n, minimum, hashed

    def minima(key: tuple, table: pa.Table) -> pa.Table:
        data, ends, _, known = texts_of(table)
        text, _, _, least, hashed = runs(data, ends, min_bytes, gram)
        text, least, hashed = text[known[text]], least[known[text]], hashed[known[text]]
        order = np.lexsort((text, least))
        text, least, hashed = text[order], least[order], hashed[order]
        new = np.append(True, least[1:] != least[:-1])[: len(least)]
        again = np.zeros(int(new.sum()), np.uint64)  # whether two texts of the part have it
        twice = ~new & np.append(False, text[1:] != text[:-1])[: len(least)]
        again[np.unique(np.cumsum(new)[twice] - 1)] = 1
        value, kind = (least[new] & ~np.uint64(1)) | again, hashed[new].astype(np.uint8)
        return packed([(b, key[0].as_py(), value[at].tobytes(), kind[at].tobytes()) for b, at in by_bucket((value >> np.uint64(1)) % np.uint64(n_buckets))], ["bucket", "part", "b_minima", "b_kinds"])

    def seen_twice(key: tuple, table: pa.Table) -> pa.Table:
        value, sizes = joined(table, "b_minima", "u8")
        part = np.repeat(table.column("part").to_numpy(), sizes)
        kind = joined(table, "b_kinds", "u1")[0]
        order = np.lexsort((kind, value >> np.uint64(1)))
        least = value[order] >> np.uint64(1)
        new = np.append(True, least[1:] != least[:-1])[: len(least)]
        head = np.flatnonzero(new)
        kinds = np.add.reduceat(np.append(True, (least[1:] != least[:-1]) | (kind[order][1:] != kind[order][:-1]))[: len(least)].astype(np.int64), head) if len(head) else head
        hot = (np.diff(np.append(head, len(least))) >= HOT_PARTS) & (kinds >= HOT_KINDS)
        several = (np.diff(np.append(head, len(least))) > 1) | np.logical_or.reduceat((value[order] & np.uint64(1)).astype(bool), head) if len(head) else np.zeros(0, bool)
        kept = several[np.cumsum(new) - 1]
        at, hot = order[kept], hot[np.cumsum(new) - 1][kept]
        return packed([(p, ((value[at[i]] & ~np.uint64(1)) | hot[i].astype(np.uint64)).tobytes()) for p, i in by_bucket(part[at])], ["part", "b_minima"])

    def fragments(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["bucket", "part", "b_sizes", "b_ids", "b_text", "b_split"]
        if not table.num_rows or not wanted.num_rows:
            return packed([], names)
        data, ends, ids, known = texts_of(table)
        text, start, count, least, hashed = runs(data, ends, min_bytes, gram)
        want = np.sort(joined(wanted, "b_minima", "u8")[0])
        place = np.minimum(np.searchsorted(want >> np.uint64(1), least >> np.uint64(1)), len(want) - 1)
        keep = np.flatnonzero(known[text] & (want[place] >> np.uint64(1) == least >> np.uint64(1)))
        owner = ids[text[keep]]
        order = keep[np.lexsort((owner, hashed[keep]))]
        new = np.append(True, hashed[order][1:] != hashed[order][:-1])[: len(order)]
        first = order[new]
        owner = ids[text[order]]
        several = np.zeros(len(first), bool)
        several[np.unique(np.cumsum(new)[~new & np.append(False, owner[1:] != owner[:-1])[: len(order)]] - 1)] = True
        hot = want[place[first]] & np.uint64(1) != 0
        compressor = zstandard.ZstdCompressor(level=3)

        def sent(begin: np.ndarray, sizes: np.ndarray, minimum: np.ndarray, twice: np.ndarray, least_id: np.ndarray, of: np.ndarray | None) -> list[tuple]:
            """Rows of fragments for each bucket; pieces go with the minimum that was split (of)."""
            out = []
            for b, at in by_bucket((minimum >> np.uint64(1)) % np.uint64(n_buckets)):
                flags = sizes[at].astype("u2") | (twice[at].astype("u2") << np.uint16(15))
                out.append((b, key[0].as_py(), flags.tobytes(), least_id[at].tobytes(), compressor.compress(data[ragged(begin[at], sizes[at])].tobytes()), b"" if of is None else of[at].tobytes()))
            return out

        i = first[~hot]
        out = sent(start[i], count[i] + min_bytes - 1, least[i], several[~hot], ids[text[i]], None)
        if hot.any():
            i = first[hot]
            run, begin, n, minimum, piece = (np.concatenate(x) for x in zip(*pieces(data, start[i], count[i])))
            owner, twice = ids[text[i]][run], several[hot][run]
            order = np.lexsort((owner, piece))
            new = np.append(True, piece[order][1:] != piece[order][:-1])[: len(order)]
            at = order[new]
            again = ~new & np.append(False, owner[order][1:] != owner[order][:-1])[: len(order)]
            twice = np.logical_or.reduceat(twice[order] | again, np.flatnonzero(new))
            out += sent(begin[at], n[at] + min_bytes - 1, minimum[at], twice, owner[at], least[i][run[at]])
        return packed(out, names)

    def found(key: tuple, table: pa.Table) -> pa.Table:
        sizes, rows = joined(table, "b_sizes", "u2")
        several, sizes = sizes >> np.uint16(15) != 0, (sizes & np.uint16(0x7FFF)).astype(np.int64)
        part, ids = np.repeat(table.column("part").to_numpy(), rows), joined(table, "b_ids", "i8")[0]
        d = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(d.decompress(x) for x in table.column("b_text").to_pylist()), np.uint8)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cut = np.repeat(np.array([len(x) > 0 for x in table.column("b_split").to_pylist()], bool), rows)
        hashed, least = np.empty(len(sizes), np.uint64), np.empty(len(sizes), np.uint64)
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE)) - 1)
            sums = prefix_sums(data[ends[lo] : ends[hi]])
            at = ends[lo:hi] - ends[lo]
            hashed[lo:hi] = spans_hash(sums, at, sizes[lo:hi])
            for size, of_size in ((gram, ~cut[lo:hi]), (long_gram, cut[lo:hi])):
                width = min_bytes - size + 1
                least[lo:hi][of_size] = spans_hash(sums, (at[of_size][:, None] + np.arange(width)).ravel(), size).reshape(-1, width).min(1)
            lo = hi
        split = np.zeros(len(sizes), np.uint64)
        split[cut] = joined(table, "b_split", "u8")[0]
        # Distinct fragments, by minimum; each with the smallest id that has it.
        order = np.lexsort((ids, hashed, least))
        new = np.append(True, (hashed[order][1:] != hashed[order][:-1]) | (least[order][1:] != least[order][:-1]))[: len(order)]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        group = np.cumsum(np.append(True, least[first][1:] != least[first][:-1])[: len(first)])
        shared = np.zeros(len(first), bool)
        shared[of[several]] = True
        shared |= np.bincount(of, minlength=len(first)) > 1
        replies = [(np.flatnonzero(shared), np.zeros(int(shared.sum()), np.int64), sizes[first[shared]], ids[first[shared]])]
        mixed = np.flatnonzero(np.bincount(group, minlength=int(group.max()) + 1)[group] > 1)
        if len(mixed):
            i = first[mixed]
            inner = np.concatenate([[0], np.cumsum(sizes[i])])
            frag, offset, length, small = fragment_repeats(data[ragged(ends[i], sizes[i])], inner, group[mixed], ids[i], min_bytes)
            replies.append((mixed[frag], offset, length, small))
        frag, offset, length, small = (np.concatenate(x) for x in zip(*replies))
        by = np.argsort(frag, kind="stable")
        frag, offset, length, small = frag[by], offset[by], length[by], small[by]
        # To every part that sent the fragment, unless its ids can lose nothing.
        lo, hi = np.searchsorted(frag, of, "left"), np.searchsorted(frag, of, "right")
        sender, reply = np.repeat(np.arange(len(of)), hi - lo), ragged(lo, hi - lo)
        useful = several[sender] | (small[reply] < ids[sender])
        sender, reply = sender[useful], reply[useful]
        return packed([(p, hashed[sender[i]].tobytes(), offset[reply[i]].astype("u2").tobytes(), length[reply[i]].astype("u2").tobytes(), small[reply[i]].tobytes(), np.unique(split[sender[i]][cut[sender[i]]]).tobytes()) for p, i in by_bucket(part[sender])], ["part", "b_hashes", "b_offsets", "b_lengths", "b_ids", "b_split"])

    def marked(key: tuple, table: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        data, ends, ids, known = texts_of(table)
        cover = np.zeros(len(data) + 1, np.int32)
        if wanted.num_rows:
            text, start, count, least, hashed = runs(data, ends, min_bytes, gram)
            split = np.unique(joined(wanted, "b_split", "u8")[0])
            if len(split):
                i = np.flatnonzero(split[np.minimum(np.searchsorted(split, least), len(split) - 1)] == least)
                more = [(i[run], begin, piece) for run, begin, _, _, piece in pieces(data, start[i], count[i])]
                run, begin, piece = (np.concatenate(x) for x in zip(*more))
                text, start, hashed = np.append(text, text[run]), np.append(start, begin), np.append(hashed, piece)
            key_, offset, length, small = (joined(wanted, c, k)[0] for c, k in (("b_hashes", "u8"), ("b_offsets", "u2"), ("b_lengths", "u2"), ("b_ids", "i8")))
            by = np.argsort(key_, kind="stable")
            key_, offset, length, small = key_[by], offset[by].astype(np.int64), length[by].astype(np.int64), small[by]
            lo, hi = np.searchsorted(key_, hashed, "left"), np.searchsorted(key_, hashed, "right")
            run, reply = np.repeat(np.arange(len(lo)), hi - lo), ragged(lo, hi - lo)
            good = known[text[run]] & (small[reply] < ids[text[run]])
            run, reply = run[good], reply[good]
            at = start[run] + offset[reply]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length[reply], -1)
        gone = np.cumsum(cover)[:-1] > 0
        head, tail = gone.copy(), gone.copy()
        head[1:] &= ~gone[:-1]
        tail[:-1] &= ~gone[1:]
        head[ends[:-1][ends[:-1] < len(data)]] = gone[ends[:-1][ends[:-1] < len(data)]]
        last = ends[1:][ends[1:] > 0] - 1
        tail[last] = gone[last]
        begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        cut = np.searchsorted(begin, ends)
        rows: list[list] = [[] for _ in names]
        for i in range(len(ids)):
            a, b = int(ends[i]), int(ends[i + 1])
            spans = [(int(s) - a, int(e) - a) for s, e in zip(begin[cut[i] : cut[i + 1]], end[cut[i] : cut[i + 1]])]
            digest, at = hashlib.sha256(), a
            for s, e in spans:
                digest.update(data[at : a + s].tobytes())
                at = a + e
            digest.update(data[at:b].tobytes())
            for x, v in zip(rows, (int(ids[i]) if known[i] else None, b - a, sum(e - s for s, e in spans), len(spans), [{"start": s, "end": e} for s, e in spans], digest.hexdigest())):
                x.append(v)
        return pa.table([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

    parts = docs.groupBy("part")
    sent = parts.applyInArrow(minima, "bucket long, part long, b_minima binary, b_kinds binary")
    wanted = sent.groupBy("bucket").applyInArrow(seen_twice, "part long, b_minima binary")
    cut = parts.cogroup(wanted.groupBy("part")).applyInArrow(fragments, "bucket long, part long, b_sizes binary, b_ids binary, b_text binary, b_split binary")
    replies = cut.groupBy("bucket").applyInArrow(found, "part long, b_hashes binary, b_offsets binary, b_lengths binary, b_ids binary, b_split binary")
    out = parts.cogroup(replies.groupBy("part")).applyInArrow(marked, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
