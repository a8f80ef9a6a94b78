"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

Three machines are compiled from a model file: the normaliser (leading space,
spaces to U+2581), the pieces, and byte fallback for characters no piece has.
Their composition with an input is a lattice over its positions; the encoding is
the path of least cost in the tropical semiring.

* Unigram models: an arc costs the piece's negative score.
* Byte-pair models: arcs cost nothing, but two pieces may follow each other only
  if the merges leave them apart when applied to just these two; other pairs cost
  infinity. A sequence is the merge result exactly if all neighbouring pairs are
  such, so one path has finite cost, and it is the only finite one that reaches
  its positions. Depth first, longest arcs first, finds it; a position from which
  the search came back once is never tried again.

Where no piece can cross (before a space, around line ends) the composition falls
apart into units, which are solved one by one and remembered, up to a bound.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType
from sentencepiece import sentencepiece_model_pb2

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT_UNITS, KEPT_LENGTH, KEPT_PAIRS = 140_000, 60, 320_000
UNIGRAM, BYTE_PAIR = 1, 2
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_COST = 10.0


class Transducer:
    """The composed machine of one model; ``encode`` and ``decode`` run it both ways."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, self.kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser is built")
        if self.kind not in (UNIGRAM, BYTE_PAIR) or not proto.trainer_spec.byte_fallback:
            raise ValueError("only unigram and byte-pair models with byte fallback are built")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.score = [p.score for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p) + 1)}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.surface = [p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"" for p in proto.pieces]
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        self.dearest = max((-self.score[i] for i in self.pieces.values()), default=0.0) + UNKNOWN_COST
        self.cost = {p: -self.score[i] for p, i in self.pieces.items()}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.pieces), "") for p in self.pieces}
        self.whole_letters = {p for p in self.pieces if len(p) == 1}
        self.units = self._unit_pattern()
        self.arcs = self._arcs()
        self.follows: dict[tuple[str, str], bool] = {}
        self.solved: dict[str, bytes] = {}  # ids of a unit, 4 bytes each
        self.older: dict[str, bytes] = {}  # what was solved before the last turn

    def _arcs(self) -> dict:
        """The pieces letter by letter: ``""`` holds the piece that ends here; a piece that goes no further stands for its node."""
        root: dict = {}
        for piece in self.pieces:
            node = root
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = piece
        todo = [root]
        while todo:
            node = todo.pop()
            for letter, below in node.items():
                if type(below) is dict:
                    if len(below) == 1 and "" in below:
                        node[letter] = below[""]
                    else:
                        todo.append(below)
        return root

    def _unit_pattern(self) -> re.Pattern:
        """Splits where no piece can cross; one unit if spaces stand inside pieces.

        Besides spaces and line ends these are places between a letter or digit
        and a mark that no piece has after a letter or digit.
        """
        longer = [p for p in self.pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return re.compile(".+", re.S)
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in longer))
        joined = {b for p in longer for a, b in zip(p, p[1:]) if a.isalnum()}
        marks = "".join(re.escape(c) for c in string.punctuation if c not in joined and c != "_")
        rest = f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")
        return re.compile((rf"{SPACE}*[^\W_]+(?=[{marks}])|" if marks else "") + rest)

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short string: best score first, then leftmost."""
        parts, cost = list(text), self.cost.get
        costs = [cost(a + b, math.inf) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < math.inf:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], math.inf)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], math.inf)
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """The merges leave these two pieces apart and whole; an empty one stands for the start or a fallback."""
        found = self.follows.get((left, right))
        if found is None:
            if len(self.follows) > KEPT_PAIRS:
                self.follows.clear()
            found = self.merged(left + right) == ([left, right] if left else [right])
            self.follows[left, right] = found
        return found

    def only_path(self, unit: str) -> tuple[int, ...]:
        """The finite path of a byte-pair model over a unit all of whose characters are pieces."""
        pieces, arcs, follows, n = self.pieces, self.arcs, self.follows, len(unit)
        path, at, closed, piece = [""], 0, set(), None
        while True:
            if piece is None:  # arrived at a new place: the longest arc first
                if at == n:
                    return tuple(map(pieces.__getitem__, path[1:]))
                node = arcs
                for letter in unit[at:]:
                    node = node.get(letter)
                    if node is None:
                        break
                    if type(node) is str:
                        piece = node
                        break
                    if "" in node:
                        piece = node[""]
            end, last = at + len(piece), path[-1]
            if end not in closed:
                good = follows.get((last, piece))
                if good or (good is None and self.may_follow(last, piece)):
                    path.append(piece)
                    at, piece = end, None
                    continue
            piece = self.shorter[piece]
            if not piece:  # no arc left here: go back and take a shorter one
                closed.add(at)
                piece = path.pop()
                at -= len(piece)

    def shortest_path(self, unit: str) -> tuple[int, ...]:
        n, pair = len(unit), self.kind == BYTE_PAIR
        if pair and self.whole_letters.issuperset(unit):
            return self.only_path(unit)
        cost, last, came = [0.0] + [math.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if cost[i] == math.inf:
                continue
            here, left = cost[i], self.text[last[i]] if last[i] >= 0 else ""
            for j in range(i + 1, n + 1):
                piece = unit[i:j]
                if piece not in self.starts:
                    break
                place = self.pieces.get(piece)
                if place is None:
                    continue
                total = here if pair else here - self.score[place]
                if total < cost[j] and (not pair or self.may_follow(left, piece)):
                    cost[j], last[j], came[j] = total, place, i
            if unit[i] not in self.pieces and here + self.dearest < cost[i + 1]:
                cost[i + 1], last[i + 1], came[i + 1] = here + (0.0 if pair else self.dearest), -1, i
        path, j = [], n
        while j > 0:
            if last[j] >= 0:
                path.append((last[j],))
            else:
                path.append(tuple(self.byte_ids[b] for b in unit[came[j] : j].encode("utf-8", "replace")))
            j = came[j]
        return tuple(chain.from_iterable(reversed(path)))

    def _solve(self, unit: str) -> bytes:
        ids = self.solved.get(unit) or self.older.get(unit) or array("i", self.shortest_path(unit)).tobytes()
        if len(unit) <= KEPT_LENGTH:
            if len(self.solved) >= KEPT_UNITS:
                self.older, self.solved = self.solved, {}
            self.solved[unit] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids, 4 bytes each."""
        if not text:
            return b""
        units = self.units.findall(self.prefix + text.replace(" ", SPACE))
        solved = list(map(self.solved.get, units))
        at = 0
        for _ in range(solved.count(None)):
            at = solved.index(None, at)
            solved[at] = self._solve(units[at])
        return b"".join(solved)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def transducer(model: bytes) -> Transducer:
    """One machine per Python worker and model."""
    return Transducer(model)


TOKENS = StructType().add("token_ids", ArrayType(IntegerType())).add("restored", BooleanType())


class Codec:
    """Column functions for the model file at ``model``, which the driver reads."""

    def __init__(self, spark: SparkSession, model: str = MODEL):
        with open(model, "rb") as file:
            shared = spark.sparkContext.broadcast(file.read())  # one vocabulary file

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(texts: pd.Series) -> pd.Series:
            machine = transducer(shared.value)
            return pd.Series([None if t is None else machine.encode(t) for t in texts], index=texts.index)

        @F.pandas_udf(StringType())
        def decode(ids: pd.Series) -> pd.Series:
            machine = transducer(shared.value)
            return pd.Series([None if x is None else machine.decode(x) for x in ids], index=ids.index)

        @F.arrow_udf(TOKENS)
        def both(texts: pa.Array) -> pa.Array:
            """Ids, and whether they decode to the text; U+2581 comes back as a space."""
            machine, values, ends, restored = transducer(shared.value), bytearray(), [0], []
            for text in texts:
                text, packed = text.as_py(), b""
                if text is not None:
                    packed = machine.packed(text)
                    values += packed
                ids = np.frombuffer(packed, np.int32).tolist()
                restored.append(text is None or machine.decode(ids) == text.replace(SPACE, " "))
                ends.append(len(values) // 4)
            ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(values)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids, mask=texts.is_null())
            return pa.StructArray.from_arrays([lists, pa.array(restored, pa.bool_())], names=TOKENS.names)

        self.encode, self.decode, self.both = encode, decode, both


def encode(docs: DataFrame, model: str = MODEL, column: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each whole text in ``column`` (replaced if there).

    Null texts give null, empty ones an empty array. Lone surrogates cannot occur
    in Spark strings. Rows, ids and other columns pass through; there is no shuffle.
    """
    return docs.withColumn(column, Codec(docs.sparkSession, model).encode(F.col("text")))


def decode(tokens: DataFrame, model: str = MODEL, column: str = "token_ids", into: str = "text") -> DataFrame:
    """``tokens`` with the text of ``column`` in ``into``; null gives null.

    Undoes ``encode`` but for U+2581 itself, which comes back as a space. Ids of
    control pieces have no text; bytes that are not UTF-8 become U+FFFD.
    """
    return tokens.withColumn(into, Codec(tokens.sparkSession, model).decode(F.col(column)))


def tokenized(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, token_ids, n_tokens, and ``restored``: whether decoding gives the text back."""
    tokens = Codec(docs.sparkSession, model).both("text")
    return docs.select("doc_id", tokens.alias("tokens")).select(
        "doc_id",
        F.col("tokens")["token_ids"].alias("token_ids"),
        F.coalesce(F.size(F.col("tokens")["token_ids"]), F.lit(0)).cast("long").alias("n_tokens"),
        F.col("tokens")["restored"].alias("restored"),
    )


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document the number of ids, their hash, and whether they decode to the text."""
    ids = F.array_join(F.transform("token_ids", lambda i: i.cast("string")), ",")
    return tokenized(docs, model).select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), "restored")
