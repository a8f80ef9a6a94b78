import random
import re

from cases import CLASHING, awkward_texts, documents, prose
from test_components import by_hand as joined_up

from bindery.llm import grouped_prefix as gp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def by_hand(texts):
    sets = [shingles(t) for _, t in texts]
    edges = [(i, i) for i in range(len(texts))]
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 80 * len(x | sets[j]):
                edges.append((i, j))
    group = joined_up(edges)
    least = {}
    for i, (doc_id, _) in enumerate(texts):
        if doc_id is not None:
            least[group[i]] = min(doc_id, least.get(group[i], doc_id))
    return [(doc_id, len(s), least.get(group[i]) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(texts, sets))], group


def near_texts(seed=9):
    """Families around the threshold, chains of near copies, and a passage that all share."""
    rng = random.Random(seed)
    out, line = [], prose(rng, 12)
    for family in range(12):
        base = prose(rng, rng.choice([6, 9, 40, 150, 400])).split(" ")
        for copy in range(8):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
            if copy % 3 == 0:
                words = words[: len(words) - rng.randrange(0, max(1, len(words) // 6))]
            out.append((1000 + 10 * family + copy, " ".join(words).upper() if copy == 5 else " ".join(words)))
            base = words if copy % 2 else base
    out += [(2000 + i, f"{line} {prose(rng, 25)}") for i in range(40)]
    return out


def check(spark, texts):
    want, _ = by_hand(texts)
    got = gp.digest(documents(spark, texts)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_awkward_texts(spark):
    check(spark, awkward_texts())


def test_near_copies(spark):
    check(spark, near_texts())


def test_one_of_each_group(spark):
    texts = awkward_texts() + near_texts()
    docs = documents(spark, texts)
    kept = gp.one_of_each_group(docs)
    assert kept.columns == docs.columns and "set_id" in CLASHING
    want, group = by_hand(texts)
    wordless = [t for t, w in zip(texts, want) if not w[1]]
    groups = {group[i] for i, w in enumerate(want) if w[1]}
    rows = kept.collect()
    assert len(rows) == len(groups) + len(wordless)
    with_words = {r.doc_id for r in rows if shingles(r.text)}
    assert with_words == {next(w[2] for i, w in enumerate(want) if group[i] == g) for g in groups}


def test_screen_keeps_every_linked_set():
    """Sets that link share enough of their first shingles, whatever their sizes."""
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(1, 80)
        x = sorted(rng.sample(range(10**6), n))
        y = sorted(rng.sample(x, rng.randrange(max(1, int(0.8 * n)), n + 1)) + rng.sample(range(10**6, 2 * 10**6), rng.randrange(0, n // 5 + 1)))
        both = len(set(x) & set(y))
        if 100 * both < 80 * len(set(x) | set(y)):
            continue
        first = [set(s[: len(s) - gp.least_overlap(len(s)) + gp.screen_length(len(s))]) for s in (x, y)]
        for s in (x, y):
            assert len(first[0] & first[1]) >= gp.screen_length(gp.least_overlap(len(s)))


def test_empty(spark):
    docs = documents(spark, [(1, None), (2, "")])
    assert sorted(tuple(r) for r in gp.digest(docs).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert gp.digest(docs.limit(0)).collect() == []
