import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from cases import awkward_texts, documents, prose

from bindery.llm import suffix_array_dedup as sd
from bindery.llm.lyndon_groups import suffix_arrays


def by_hand(texts):
    rows = [(i, (t or "").encode()) for i, t in texts]
    first = {}
    for i, data in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for s in range(len(data) - 99):
            first.setdefault(data[s : s + 100], (i, data, s))
    out = []
    for i, data in rows:
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if first[data[s : s + 100]] != (i, data, s):
                gone[s : s + 100] = True
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(spark, texts):
    got = sorted((tuple(r) for r in sd.digest(documents(spark, texts)).collect()), key=repr)
    assert got == by_hand(texts)


def unique_ids(texts):
    """Of one id only equal texts: which of two different ones is first is a hash's choice."""
    seen = {}
    return [(i, t) for i, t in texts if seen.setdefault(i, t) == t]


def overlapping(seed, n=60):
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([8, 20, 40, 90])) for _ in range(8)]
    passages += ["ab" * 90, "x" * 250, "é" * 80, "naïve çà " * 30]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            parts += [prose(rng, rng.randrange(0, 9)), p[rng.randrange(0, 30) :]]
        out.append((i * 7 % n, " ".join(parts)))
    return out


def test_awkward_texts(spark):
    check(spark, unique_ids(awkward_texts()))


def test_overlapping_passages_and_periods(spark):
    check(spark, overlapping(1))


def test_small_portions_and_hot_anchors_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sd, "PORTION", 300)
    monkeypatch.setattr(sd, "LONGEST", 40)
    monkeypatch.setattr(sd, "SHARD_BYTES", 4000)
    monkeypatch.setattr(sd, "HOT_BYTES", 400)
    monkeypatch.setattr(sd, "PART_WINDOWS", 30)
    check(spark, overlapping(2, 40))


def test_hot_passage_in_many_contexts(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_BYTES", 2000)
    rng = random.Random(5)
    passage = prose(rng, 45)
    check(spark, [(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for i in range(150)])


def test_texts_of_one_id_keep_one_copy(spark):
    rng = random.Random(3)
    same = prose(rng, 60)
    out = sd.digest(documents(spark, [(4, same + " a"), (4, same + " b"), (None, same), (None, None)])).collect()
    left = [r for r in out if r.n_bytes and r.n_removed == 0]
    assert len(left) == 1 and left[0].doc_id == 4
    assert [r.n_removed for r in out if r.doc_id is None] in ([len(same), 0], [0, len(same)])


def test_empty(spark):
    docs = documents(spark, [(1, None), (2, "")])
    assert sorted(tuple(r)[:4] for r in sd.digest(docs).collect()) == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert sd.digest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcd", bytes(range(256))])
def test_suffix_arrays_against_sorting(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(rng.randrange(0, 9))]
        strings += [rng.choice([b"", b"abaab" * 5, b"banana", b"zyx" * 4])]
        starts = np.cumsum([0, *map(len, strings)])
        got = suffix_arrays(np.frombuffer(b"".join(strings), np.uint8), starts)
        for s, a, b in zip(strings, starts, starts[1:]):
            assert (got[a:b] - a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_memory_of_long_texts_is_bounded_by_portions():
    data = np.random.default_rng(2).integers(97, 123, 3_000_000).astype(np.uint8)
    batch = pa.RecordBatch.from_pydict({"text": [data.tobytes().decode()]})
    sd.held_powers.clear()
    tracemalloc.start()
    rows = sum(b.num_rows for b in sd.list_anchors(iter([batch])))
    keys = sd.all_windows(data)
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows > 0 and len(keys) == len(data) - sd.WINDOW + 1
    assert most - keys.nbytes * 2 < 32e6 and held - keys.nbytes < 12e6
    some = data[sd.PORTION - 500 : sd.PORTION + 500]
    assert (keys[sd.PORTION - 500 : sd.PORTION + 500 - sd.WINDOW + 1] == sd.Hashes(some).every(sd.WINDOW)).all()


def test_periods_and_equal_runs_are_not_sorted(monkeypatch):
    rng = random.Random(8)
    passage, word = prose(rng, 40).encode()[:180], b" The" * 200
    edges = [bytes(rng.randrange(256) for _ in range(60)) for _ in range(40)]
    held = [word, *(edges[i] + passage + edges[i + 20] for i in range(20))]
    pieces = pd.DataFrame({"anchor": 1, "part": 0, "no_id": False, "doc_id": range(len(held)), "row_key": 0, "first": 5, "piece": held})
    sorted_bytes = []
    monkeypatch.setattr(sd, "suffix_arrays", lambda data, starts: sorted_bytes.append(len(data)) or suffix_arrays(data, starts))
    gone = sd.sort_shard(pieces)
    covered = {i: set() for i in range(len(held))}
    for row in gone.itertuples(index=False):
        covered[row.doc_id] |= set(range(row.start, row.start + row.length))
    assert covered[0] == set(range(5 + 4, 5 + 800)) and covered[1] == set()
    assert all(covered[i] == set(range(65, 65 + 180)) for i in range(2, 21))
    assert sum(sorted_bytes) <= 400
