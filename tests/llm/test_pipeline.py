"""The pipeline against its stages by brute force, on a small table."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from tidewell.llm import bpe, quality, secrets

from .test_duplicates import hits_brute, near_brute


def test_pipeline(spark, docs, vocabulary, tmp_path):
    import zstandard

    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(3)]
    rows = [(i, say(rnd.randint(10, 90))) for i in range(50)]
    rows += [(100 + i, rows[i][1] + " extra") for i in range(20)] + [(200 + i, items[i][1] + " " + say(20)) for i in range(3)]
    rows += [(300, say(40) + ' token = "abcdef123456"'), (301, None), (302, "spam spam " * 40)]
    d = f"{tmp_path}/d"
    docs(rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect()}

    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    left = [(i, t) for i, t in rows if quality.measure(t, z)[6]]
    near = near_brute(left)
    left = [(i, t) for i, t in left if near[i][2]]
    hit = hits_brute(left, items)
    left = [(i, t) for i, t in left if not hit[i][4]]
    want, c = {}, bpe.codec(vocabulary)
    for i, t in left:
        t = secrets.masked(t, secrets.scan(t)[1])
        ids = np.array(c.encode(t), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want
    assert 300 in got and not {100, 200, 301, 302} & set(got)


CLASHES = ("kept", "n_words", "ratio", "verdict", "spans", "masked", "contaminated", "items", "component_id", "n_shingles", "row", "c0", "c1", "id", "rep", "a.b")


def test_stages_keep_the_columns(spark, docs, tmp_path):
    """Extra columns named like each operator's own ones, nulls and repeated rows: columns and values stay."""
    rnd = random.Random(7)
    say = lambda n: " ".join("".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    d = f"{tmp_path}/d"
    rows = [(1, say(60) + " token = abcdef123"), (2, None), (None, None), (None, say(50)), (4, ""), (5, say(80)), (5, say(80)), (6, "a b c")]
    docs([*rows, rows[0], rows[5]], *CLASHES).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, d)
        assert out.columns == table.columns and [f.dataType for f in out.schema] == [f.dataType for f in table.schema], name
        got = out.collect()
        assert got and all(r[c] == "x" for r in got for c in CLASHES), name
        left = {"quality rules": {1, 5, None}, "decontamination": {1, 2, None, 4, 5}}.get(name, {1, 2, None, 4, 5, 6})
        assert {r.doc_id for r in got} == left, name
        for r in got:
            assert r.n_chars == len(r.text or "") and (r.text is None or ("<assign>" if name == "secrets" and r.doc_id == 1 else "") in r.text)
    assert corpus_pipeline.run(spark, d).count() == 6  # rows that share an id stay
    assert stage_names() == ["quality rules", "near-duplicates", "decontamination", "secrets", "encoding"]


def stage_names():
    return [n for n, _ in corpus_pipeline.STAGES]
