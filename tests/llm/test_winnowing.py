import hashlib
import random
import re

from cases import awkward_texts, documents, prose

from bindery.llm import winnowing


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def by_hand(texts, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = []
    for doc_id, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        names = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def planted():
    rng = random.Random(5)
    items = [(i, prose(rng, 30)) for i in range(6)] + [(7, "kalo mi"), (8, "Zwölf Ziele"), (9, None), (10, ""), (None, prose(rng, 20))]
    items += [(11, "la " * 40), (0, prose(rng, 25))]
    texts = awkward_texts()
    for n, (_, item) in enumerate(items):
        part = (item or "").split(" ")
        for cut in (13, 12, 40):
            texts.append((200 + 10 * n + cut % 7, f"{prose(rng, rng.randint(0, 90))} {' '.join(part[:cut]).upper()}! {prose(rng, 5)}"))
    texts += [(400, "la " * 15), (401, "la la la"), (402, f"{items[0][1]} {items[1][1]} " * 3)]
    return texts, items


def test_against_brute_force(spark):
    texts, items = planted()
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = winnowing.digest(documents(spark, texts), benchmark)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(texts, items)


def test_filter_keeps_the_rest(spark):
    texts, items = planted()
    benchmark = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    docs = documents(spark, texts)
    kept = winnowing.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    want = sorted(repr(r[0]) for r in by_hand(texts, items) if not r[-1])
    assert sorted(repr(r.doc_id) for r in kept.collect()) == want


def test_empty_tables(spark):
    docs = documents(spark, [(1, "a b c")])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in winnowing.digest(docs, none).collect()] == [0]
    assert winnowing.digest(docs.limit(0), none).collect() == []


def test_no_python_on_the_main_path(spark):
    texts, items = planted()
    benchmark = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    plan = winnowing.digest(documents(spark, texts), benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
