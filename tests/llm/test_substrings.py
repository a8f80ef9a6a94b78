import hashlib
import random
import re

from cases import awkward_texts, documents, prose

from bindery.llm import suffix_automata as sa


def by_hand(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    least = {}
    for (doc_id, _), w in zip(texts, words):
        for s in range(len(w) - 49):
            if doc_id is not None:
                key = tuple(w[s : s + 50])
                least[key] = min(doc_id, least.get(key, doc_id))
    out = []
    for (doc_id, _), w in zip(texts, words):
        gone = set()
        for s in range(len(w) - 49):
            if doc_id is not None and least[tuple(w[s : s + 50])] < doc_id:
                gone.update(range(s, s + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def overlapping(seed=4):
    """Passages of 45 to 160 words in random contexts, edited copies, and repeats inside a text."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.choice([45, 49, 50, 51, 60, 95, 160])).split(" ") for _ in range(12)]
    out = []
    for i in range(70):
        words = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 12)
            words += prose(rng, rng.randrange(1, 30)).split(" ") + p[cut:]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "edited"
        out.append((rng.randrange(1000), " ".join(words)))
    return out


def check(spark, texts):
    got = sa.digest(documents(spark, texts)).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(texts)


def test_awkward_texts(spark):
    check(spark, awkward_texts())


def test_overlapping_passages(spark):
    check(spark, overlapping())


def test_small_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(sa, "SHARD_WORDS", 150)
    monkeypatch.setattr(sa, "PORTION_WORDS", 100)
    check(spark, overlapping(5))


def test_automaton_against_search():
    rng = random.Random(1)
    for _ in range(40):
        texts = [[rng.choice("ab") for _ in range(rng.randrange(50, 140))] for _ in range(6)]
        texts.append(texts[0][5:70])
        automaton = sa.Automaton()
        for owner, words in enumerate(texts[:4]):
            automaton.add(words, owner)
        automaton.finish()
        windows = {}
        for owner, words in enumerate(texts[:4]):
            for s in range(len(words) - 49):
                windows.setdefault(tuple(words[s : s + 50]), owner)
        for words in texts:
            want = [windows.get(tuple(words[s : s + 50])) for s in range(len(words) - 49)]
            assert automaton.least_owners(words) == want


def test_empty(spark):
    docs = documents(spark, [(1, None)])
    assert [tuple(r)[:3] for r in sa.digest(docs).collect()] == [(1, 0, 0)]
    assert sa.digest(docs.limit(0)).collect() == []
