import random

import numpy as np
import pytest
import sentencepiece
from cases import awkward_texts, documents
from sentencepiece import sentencepiece_model_pb2

from bindery.llm import sentencepiece_fst as fst

ALPHABET = " \n\tabcthe éßñ日本梦𝄞xyzW.,!?***$$$0123<s></s><0x41>ﬁ"


@pytest.fixture(scope="module")
def raw():
    with open(fst.MODEL, "rb") as file:
        return file.read()


def random_texts(pieces, seed=2):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(2500)]
    return out + [" " * n + "the" + " " * n for n in range(60)] + ["a" * n for n in range(80)] + ["the" * n for n in range(20)]


def test_byte_pair_model_matches_the_library(raw):
    machine = fst.Transducer(raw)
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in random_texts(list(machine.pieces)):
        ids = machine.encode(text)
        assert ids == library.encode(text), text
        assert machine.decode(ids) == text.replace("▁", " ")


def test_unigram_model_matches_the_library(raw):
    """The same pieces as a unigram model with random scores: least cost, not merges."""
    model, rng = sentencepiece_model_pb2.ModelProto(), random.Random(4)
    model.ParseFromString(raw)
    model.trainer_spec.model_type = fst.UNIGRAM
    for piece in model.pieces:
        if piece.type == fst.NORMAL:
            piece.score = -rng.uniform(5, 15)
    machine = fst.Transducer(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in random_texts(list(machine.pieces), 5)[::4]:
        ids = machine.encode(text)
        assert sum(-machine.score[i] for i in ids) == pytest.approx(sum(-machine.score[i] for i in library.encode(text)), rel=1e-4)
        assert machine.decode(ids) == text.replace("▁", " ")


def test_rows(spark, raw):
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = [*awkward_texts(), (900, "x" * 20_000)]
    docs = documents(spark, texts)
    out = fst.encode(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    got = sorted(((r.doc_id, r.text, r.token_ids) for r in out.collect()), key=repr)
    assert got == sorted(((i, t, None if t is None else library.encode(t)) for i, t in texts), key=repr)
    assert all(r.restored for r in fst.digest(docs).collect())
    assert fst.digest(docs.limit(0)).collect() == []


def test_other_models_are_refused(raw):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(raw)
    model.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        fst.Transducer(model.SerializeToString())


def test_ids_stay_packed_and_null_texts_stay_null(spark):
    machine = fst.transducer(open(fst.MODEL, "rb").read())
    texts = ["one two  three\n", "", "wörld \U0001f600", "thnthaat ▁ lasramiie!"]
    for text in texts:
        ids = machine.encode(text)
        assert machine.packed(text) == np.array(ids, np.int32).tobytes()
    assert all(type(ids) is bytes for ids in machine.solved.values())  # no list of numbers is remembered
    rows = [(i, t) for i, t in enumerate([None, *texts, None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = [tuple(r) for r in fst.tokenized(docs).orderBy("doc_id").collect()]
    ids = [None if t is None else machine.encode(t) for _, t in rows]
    assert got == [(i, x, len(x or []), True) for i, x in enumerate(ids)]


def test_arcs_name_the_pieces_that_start_a_text():
    machine = fst.transducer(open(fst.MODEL, "rb").read())
    for piece in list(machine.pieces)[::97]:
        found, node = [], machine.arcs
        for letter in piece:
            node = node[letter]
            found += [node] if type(node) is str else [node[""]] if "" in node else []
        assert found == [piece[:n] for n in range(1, len(piece) + 1) if piece[:n] in machine.pieces]


def test_units_of_a_large_vocabulary_are_solved_once(raw, monkeypatch):
    machine, asked = fst.Transducer(raw), []
    solve = machine.shortest_path
    monkeypatch.setattr(machine, "shortest_path", lambda unit: asked.append(unit) or solve(unit))
    words = [np.base_repr(46_656 + i, 36).lower() for i in range(120_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    first = [machine.packed(t) for t in texts]
    assert [machine.packed(t) for t in texts] == first
    assert len(asked) == len(set(asked))
