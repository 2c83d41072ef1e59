"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the whole corpus (0: the most frequent), so most fit one byte. Four ranks share a control
byte that holds their lengths (two bits each); data bytes stand apart, little-endian. Reading looks the four lengths up in a
table of 256 rows and gathers the data bytes with numpy, without a loop over ids.

A file set is a folder of Parquet files, which any shared store can hold. Each row is a block of documents in ascending id order:
shard, block, before (ids of the shard before it), n_ids, doc_ids (int64), sizes (uint32), control, data. Shards are ranges of document ids.
Beside it stands the table of ranks (one row for each id of the vocabulary).

Cases: a null text counts as empty: just the end id. Rows without document id come first; rows of one id follow each other in the
order of their coded bytes. An empty table gives a file set without blocks. Other columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import BATCH_ROWS, map_arrow, pick, released, shared_dir, tidied
from .words import ragged

#: Ids in a shard (a range of documents) and in a block of it, about.
SHARD_IDS = 4_000_000
BLOCK_IDS = 1_000_000
#: Shards at most: beyond that they grow. So many numbers (where shards begin, how many ids come before) reach the driver and the tasks.
MOST_SHARDS = 1 << 16
#: Units in a generation of a Python worker's memory. Speed only.
REMEMBERED = 600_000
#: White space of Unicode, as a class of Arrow's patterns.
WHITE = r"\x{09}-\x{0d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

#: The four lengths that a control byte holds.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def coded(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of the ranks (below 2 ** 32) of documents that follow each other, and where each document's end.

    Each document begins a control byte; its last group of four may have fewer ids, which then have no data bytes.
    """
    groups = -(-sizes // 4)
    ends = np.cumsum(sizes)
    size = np.ones(len(ranks), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        more = ranks > limit
        if not more.any():
            break
        size += more
    first = np.cumsum(groups) * 4 - groups * 4
    slot = np.zeros(int(groups.sum()) * 4, np.uint8)
    slot[np.arange(len(ranks)) + np.repeat(first - (ends - sizes), sizes)] = size - 1
    slot = slot.reshape(-1, 4)
    control = slot[:, 0] | slot[:, 1] << 2 | slot[:, 2] << 4 | slot[:, 3] << 6
    width = int(size.max(initial=1))
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width] if width > 2 else ranks.astype("<u2").view(np.uint8).reshape(-1, 2)
    data = raw[np.arange(raw.shape[1]) < size[:, None]]
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], ends])]
    return control, np.concatenate([[0], np.cumsum(groups)]), data, at


def decoded(control: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All ranks of documents that follow each other; sizes: ids of each (each begins a control byte)."""
    groups = -(-sizes // 4)
    length = LENGTHS[control].ravel()
    # Where a document's last group of four has fewer ids, the rest is not there.
    first = np.cumsum(groups) - groups
    keep = np.ones(len(length), bool)
    spare = groups * 4 - sizes
    for k in (1, 2, 3):
        keep[((first + groups) * 4 - k)[spare >= k]] = False
    length = length[keep]
    at = np.cumsum(length, dtype=np.int64) - length
    out = data[at].astype(np.uint32)
    for j in (1, 2, 3):
        more = np.flatnonzero(length > j)
        if not len(more):
            break
        out[more] |= data[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


class Encoder:
    """The tokenizers library behind a bounded memory of units: the library encodes each unit, once while it is remembered.

    Units are cut where a pre-split piece always begins: before a blank or a line end between other characters, after that line
    end, and around [.,!] that follow a letter and end a word. So a unit's ids do not depend on what stands around it. A
    unit that is a single piece goes straight to the library's model, others through its whole pipeline; so do whole texts
    in which white space meets white space or a special token's string stands.
    Memory has two generations: units used since the older one was closed move on, the rest is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.unsafe = "|".join(["\x00", f"[ \\n][{WHITE}]", f"[{WHITE}][ \\n]", "^ ", " $", *map(re.escape, self.special)])
        self.letters = {b: chr(c) for b, c in ((b, ord(c)) for c, b in byte_alphabet().items())}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str]) -> list[bytes]:
        """Ids of all units, which are in the young generation afterwards."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        known = list(map(young.get, units))
        rest, tokenize, letters = [], self.tokenizer.model.tokenize, self.letters
        for i, ids in enumerate(known):
            if ids is not None:
                continue
            u = units[i]
            if (ids := old.get(u)) is None:
                if not (u[1:] if u[:1] == " " else u).isalpha():
                    rest.append(i)
                    continue
                piece = "\u0120" + u[1:] if u[0] == " " and u.isascii() else u.encode().decode("latin-1").translate(letters)
                ids = array("I", [t.id for t in tokenize(piece)]).tobytes()
            young[u] = known[i] = ids
        for i, ids in zip(rest, self.library([units[i] for i in rest])):
            young[units[i]] = known[i] = ids
        return known

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and how many each has. Null counts as empty."""
        column = pc.fill_null(column.cast(pa.string()), "")
        odd = np.flatnonzero(pc.match_substring_regex(column, self.unsafe).to_numpy(zero_copy_only=False))
        direct = self.library(column.take(pa.array(odd)).to_pylist())
        if len(odd):
            plain = np.ones(len(column), bool)
            plain[odd] = False
            column = pc.if_else(pa.array(plain), column, "")
        marked = pc.replace_substring(pc.replace_substring(column, " ", "\0 "), "\n", "\0\n\0")
        units = pc.split_pattern(pc.replace_substring_regex(marked, r"(\pL)([.,!]+)\x00", "\\1\0\\2\0"), "\0")
        coded_units = units.flatten().dictionary_encode()
        known = self.learn(coded_units.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        place = coded_units.indices.to_numpy()
        each = lengths[place]
        ids = np.frombuffer(b"".join(known), "<u4")[ragged((np.cumsum(lengths) - lengths)[place], each)]
        cuts = units.offsets.to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(each)])[cuts - cuts[0]]
        sizes = np.diff(ends)
        if len(odd):
            own = {int(i): np.frombuffer(d, "<u4") for i, d in zip(odd, direct)}
            parts = [own[i] if i in own else ids[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            ids, sizes = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, sizes


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write the file set to `path` (blocks, and ranks beside them)."""
    docs = pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(2 * BATCH_ROWS))  # a batch's repeated units are looked up once

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, e = ["id", "n_ids", "ids", "counts"], encoder(vocabulary)
        total = np.zeros(max(e.size, end_id + 1), np.int64)
        small = "<u2" if len(total) <= 1 << 16 else "<u4"
        for batch in batches:
            ids, sizes = e.encode(batch.column(1))
            ids = np.insert(ids.astype(small), np.cumsum(sizes), end_id)
            total += np.bincount(ids, minlength=len(total))
            sizes = sizes + 1
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.dtype(small).itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), blobs, pa.nulls(len(sizes), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    raw = f"{shared_dir(spark)}/ids"
    docs.mapInArrow(tidied(encode), "id long, n_ids long, ids binary, counts binary").write.option("compression", "lz4").parquet(raw)
    kept = spark.read.schema("id long, n_ids long, ids binary, counts binary").parquet(raw)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = sum(np.frombuffer(x, np.int64) for x in batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    # A row for each id of the vocabulary: bounded.
    counted = map_arrow(kept.select("counts").filter(F.col("counts").isNotNull()), spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    order = [r.token for r in sorted(counted, key=lambda r: (-r.n, r.token))]
    spark.createDataFrame([(i, t) for i, t in enumerate(order)], "rank long, token long").coalesce(1).write.parquet(f"{path}/ranks")
    small = "<u2" if encoder_size(vocabulary, end_id) <= 1 << 16 else "<u4"
    rank = np.zeros(max(order, default=0) + 1, small)
    rank[order] = np.arange(len(order), dtype=small)

    rows = kept.filter(F.col("n_ids").isNotNull()).select("id", "n_ids", "ids")
    n_ids = rows.agg(F.sum("n_ids")).first()[0] or 0
    n_shards = min(MOST_SHARDS, max(1, -(-n_ids // SHARD_IDS)))
    cuts = np.array(sorted(set(rows.approxQuantile("id", [k / n_shards for k in range(1, n_shards)], 0.25 / n_shards) if n_shards > 1 and n_ids else [])), np.int64)

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column(1).to_numpy()
        raw = batch.column(2)
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        control, c, data, at = coded(rank[np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(small)], sizes)
        control, data = control.tobytes(), data.tobytes()
        pairs = [(control[a:b], data[x:y]) for a, b, x, y in zip(c[:-1].tolist(), c[1:].tolist(), at[:-1].tolist(), at[1:].tolist())]
        ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, ids, "right").astype(np.int64)), batch.column(0), batch.column(1), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["shard", "id", "n_ids", "control", "data"])

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "before", "n_ids", "known", "doc_ids", "sizes", "control", "data"]
        held: list[tuple] = []  # runs of rows: known, ids, sizes, control, data
        shard, block, before, n = -1, 0, 0, 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, block, before, n)] + [pa.array([b"".join(x)], pa.binary()) for x in zip(*held)], names=names)

        def between(column: pa.Array, a: int, b: int) -> bytes:
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset + a : column.offset + b + 1]
            return column.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes() if column.buffers()[2] else b""

        for batch in batches:
            shards, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            ids = batch.column(1)
            known, ids = ~ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            a = 0
            while a < len(sizes):
                if held and (shards[a] != shard or n >= BLOCK_IDS):
                    yield full()
                    block, before, held, n = block + 1, before + n, [], 0
                if shards[a] != shard:
                    shard, block, before = int(shards[a]), 0, 0
                # As many rows as the shard, the batch and the block leave room for, one at least.
                room = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_IDS - n)) + 1
                b = max(a + 1, min(room, int(np.searchsorted(shards, shard, "right")), len(sizes)))
                held.append((known[a:b].tobytes(), ids[a:b].astype("<i8").tobytes(), sizes[a:b].astype("<u4").tobytes(), between(batch.column(3), a, b), between(batch.column(4), a, b)))
                n += int(sizes[a:b].sum())
                a = b
        if held:
            yield full()

    dealt = map_arrow(rows, code, "shard long, id long, n_ids long, control binary, data binary").repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "id", "control", "data")
    dealt.mapInArrow(block_up, "shard long, block long, before long, n_ids long, known binary, doc_ids binary, sizes binary, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    kept.written_to = raw
    released(kept)


def encoder_size(vocabulary: str, end_id: int) -> int:
    return max(encoder(vocabulary).size, end_id + 1)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """A file set's documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids (binary, little-endian uint32) if asked for."""
    blocks = spark.read.parquet(f"{path}/blocks")
    # A number for each of at most MOST_SHARDS shards, and the vocabulary.
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    n_ids = np.array([totals.get(k, 0) for k in range(max(totals, default=0) + 1)], np.int64)
    offset = np.cumsum(n_ids) - n_ids
    token = np.array([r.token for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, known, doc_ids, sizes, control, data in zip(*[c.to_pylist() for c in batch.columns]):
                sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
                ids = token[decoded(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), sizes)]
                ends = np.cumsum(sizes)
                cut = [ids[e - s : e].tobytes() for s, e in zip(sizes, ends)]
                known = np.frombuffer(known, bool)
                columns = [pa.array(np.frombuffer(doc_ids, "<i8"), pa.int64(), mask=~known), pa.array(offset[shard] + before + ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(cut, pa.binary())] * with_ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return blocks.select("shard", "before", "known", "doc_ids", "sizes", "control", "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
