"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SYLLABLES = "ka lo mi ner tu sa vel dro pi ash en or ul zi mo".split()
CLASHING = (
    "row_key set_id label node words hits items score held_out lang_pred secrets token_ids removed_lines "
    "_gone _gone_id _gone_key _line_key _group_key _tagged _crf_tagged anchor segment owner prefix n_shingles component_id chosen file_no nth runs bucket first"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def awkward_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Unrelated, equal, near-equal and overlapping texts, and the odd ones."""
    rng = random.Random(seed)
    base = prose(rng, 140)
    passage = prose(rng, 60)
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (None, base), (None, None), (7, prose(rng, 3000)),
    ]
    out += [(10 + i, base) for i in range(5)]
    out += [(20, base), (20, base), (20, prose(rng, 80))]
    for i in range(8):  # one or two words changed
        words = base.split(" ")
        for _ in range(1 + i % 2):
            words[rng.randrange(len(words))] = f"changed{i}"
        out.append((30 + i, " ".join(words)))
    out += [(50 + i, f"{prose(rng, 30)} {passage}\n{prose(rng, 40)}") for i in range(6)]
    out += [(60, "the " * 200), (61, "the " * 180), (62, "ÀÉ straße ÀÉ \x0b ends\x1fhere " * 20)]
    out += [(70 + i, prose(rng, 100)) for i in range(6)]
    rng.shuffle(out)
    return out


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], lang: str | None = "xx") -> DataFrame:
    rows = [(i, t, lang, "s", len(t or ""), *["clash"] * len(CLASHING)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
