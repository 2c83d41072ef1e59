"""BPE and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import bpe, token_files

BITS = [" a", " b", ",", " the", ".", "!", " é", " 12", " ", "\n", "\t", "a", "ñ", "³", "'s", "'", "’", "中文", "\U0001f600", "​", "\xa0", "　", "\x1c", "\x85", "\x00", "́", "᠎", "<|endoftext|>", "<|", "ing", "....", "==", "  ", "\r\n", "Ⅷ", "٣"]


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def texts(n=400, seed=2):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", "a" * 4000, "ab" * 2000, " " * 999, "\n" * 50 + "x"]


def ids_of(library, ts):
    return [e.ids for e in library.encode_batch(ts, add_special_tokens=False)]


def test_codec_equals_library(vocabulary, library):
    c, ts = bpe.codec(vocabulary), texts()
    want = ids_of(library, ts)
    assert [c.encode(t) for t in ts] == want
    assert [c.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_codec_on_any_text(text):
    from tidewell.llm.queries import vocabulary

    c = bpe.codec(vocabulary())
    from tokenizers import Tokenizer

    lib = test_codec_on_any_text.__dict__.setdefault("lib", Tokenizer.from_file(vocabulary()))
    assert c.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert c.decode(c.encode(text)) == text


def test_memory_is_speed_only(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    c, ts = bpe.Codec(vocabulary), texts(60, 5)
    assert [c.encode(t) for t in ts] == ids_of(library, ts)
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    e = token_files.Encoder(vocabulary)
    for _ in range(3):
        ids, sizes = e.encode(pa.array(ts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == ids_of(library, ts)


def test_round_trip_query(docs, vocabulary, library):
    ts = texts(50) + [None]
    rows = bpe.bpe_round_trip(docs(list(enumerate(ts)), "ids", "id"), vocabulary).collect()
    for r, t in zip(sorted(rows, key=lambda r: r.doc_id), ts):
        ids = np.array(ids_of(library, [t or ""])[0], "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.decoded) == (len(ids) // 4, ids, t or "")
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest() and r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(docs([]), vocabulary).count() == 0


def test_coding_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(200):
        parts = [rng.integers(0, rng.choice([200, 300, 70000, 2**25]), rng.integers(0, 40)).astype(np.uint32) for _ in range(rng.integers(1, 9))]
        sizes = np.array([len(p) for p in parts])
        control, c, data, at = token_files.coded(np.concatenate(parts), sizes)
        assert (token_files.decoded(control, data, sizes) == np.concatenate(parts)).all()
        for i, p in enumerate(parts):
            one = token_files.decoded(control[c[i] : c[i + 1]], data[at[i] : at[i + 1]], sizes[i : i + 1])
            assert (one == p).all()


@pytest.mark.parametrize("shard,block", [(4_000_000, 1_000_000), (300, 100)])
def test_token_files(spark, docs, vocabulary, library, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(token_files, "SHARD_IDS", shard)
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    ts = [*texts(150), None]
    order = list(range(len(ts)))
    random.Random(1).shuffle(order)
    rows = [(i * 5, ts[i]) for i in order]
    path = f"file://{tmp_path}/files"
    token_files.write_tokens(docs(rows, "ids", "shard"), vocabulary, path, 2)
    got = {r.doc_id: r for r in token_files.read_tokens(spark, path).collect()}
    start = 0
    for i, ids in enumerate(ids_of(library, [t or "" for t in ts])):
        ids = np.array([*ids, 2], "<u4")
        r = got[i * 5]
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)


def test_token_files_edges(spark, docs, vocabulary, tmp_path):
    path = f"file://{tmp_path}/empty"
    token_files.write_tokens(docs([]), vocabulary, path, 2)
    assert token_files.read_tokens(spark, path).count() == 0
    path = f"file://{tmp_path}/nulls"
    token_files.write_tokens(docs([(None, "a b"), (4, "c"), (4, "d e"), (1, None)]), vocabulary, path, 2)
    got = sorted((r.start, r.doc_id) for r in token_files.read_tokens(spark, path).collect())
    assert [i for _, i in got] == [None, 1, 4, 4]
