import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cases import awkward_texts, documents

from bindery.llm import token_files as tf
from bindery.session import scratch_path


def by_hand(ids, separator):
    out, size = [], 0
    for x in ids:
        if x == separator:
            out.append((size, True))
            size = 0
        else:
            size += 1
    return out + ([(size, False)] if size else [])


@pytest.mark.parametrize("block", [1, 3, 7, 64, 1 << 20])
def test_any_block_size_gives_the_same_documents(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(tf, "SPAN", 4)
    rng = random.Random(7)
    want, separator = {}, 50256
    for n in range(5):
        ids = [separator if rng.random() < 0.15 else rng.choice([0x50C4, 0xC450 - 1, 0x50, 0xC4, 7]) for _ in range([0, 1, 40, 200, 333][n])]
        if n == 3:
            ids[20:120] = [9] * 100  # a document over many blocks
        data = np.array(ids, "<u2").tobytes() + (b"\x50" if n == 2 else b"")
        (tmp_path / f"part-{n}").write_bytes(data)
        want[f"part-{n}"] = by_hand(ids, separator)
    got = {}
    for r in tf.count_tokens(spark, f"file://{tmp_path}", separator, block).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.nth, r.n_tokens, r.ended))
    assert {k: [(n, e) for _, n, e in sorted(v)] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert all([x[0] for x in sorted(v)] == list(range(len(v))) for v in got.values())


def test_counts_of_documents(spark, tmp_path):
    texts = [*awkward_texts(), (900, "mixed <|endoftext|> text"), (901, "ä" * 999)]
    with open(tf.RANKS, "rb") as file:
        coder = tf.encoding(file.read())
    documents(spark, texts).repartition(5).write.parquet(str(tmp_path / "docs"))
    got = tf.digest(spark.read.parquet(str(tmp_path / "docs"))).collect()
    want = sorted(((i, len(coder.encode_ordinary(t or ""))) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == want
    assert all(r.ended for r in got)


def test_places_hold_when_the_splits_change(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    texts = pa.table({"doc_id": list(range(4000)), "text": ["word " * (i % 37) for i in range(4000)]})
    pq.write_table(texts, path, row_group_size=100)
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, ("4", "64m", "1")):
            spark.conf.set(n, v)
        out = tf.digest(spark.read.parquet(path))
        for n, v in zip(names, ("16", "4k", "1")):
            spark.conf.set(n, v)
        got = {r.doc_id: r.n_tokens for r in out.collect()}
    finally:
        for n, v in old.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    with open(tf.RANKS, "rb") as file:
        coder = tf.encoding(file.read())
    assert got == {i: len(coder.encode_ordinary(t)) for i, t in enumerate(texts.column("text").to_pylist())}


def test_files_without_places_are_not_scanned(spark):
    path = scratch_path(spark, "token-files")
    placed = tf.write_token_files(documents(spark, [(1, "a b c")]), path)
    system, folder = tf.file_system(path)
    with system.open_output_stream(f"{folder}/part-0-left-behind") as file:
        file.write(b"\x01\x00" * 9)
    counts = tf.count_tokens(spark, path, only=placed.select("file").distinct())
    assert [r.ended for r in counts.collect()] == [True]


def test_empty(spark):
    assert tf.digest(documents(spark, [(1, "a")]).limit(0)).collect() == []
    path = scratch_path(spark, "token-files")
    tf.write_token_files(documents(spark, [(1, None)]), path)
    assert [(r.n_tokens, r.ended) for r in tf.count_tokens(spark, path).collect()] == [(0, True)]
