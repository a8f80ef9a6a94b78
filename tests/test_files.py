"""One file per row, written by the tasks."""

import os

from pyspark.sql import functions as F

from bindery.plans.queries import read_files_decode
from bindery.session import shared_dir
from bindery.sources import folders

ODD = [None, "", "en", "a/b", "x=y", "100%", "%41", "ü [z]^{", "tab\there", "q\"'*?\\:#", "dé\x7f"]


def contents(path):
    """Folder to the sorted contents of its files."""
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".txt"):
                with open(os.path.join(folder, name), "rb") as file:
                    found.setdefault(os.path.relpath(folder, path), []).append(file.read())
    return {k: sorted(v) for k, v in found.items()}


def test_folders_and_files_are_those_of_sparks_writer(spark, tmp_path):
    rows = spark.createDataFrame(
        [(v, bytearray(f"{i}\xe9 {v}".encode("latin-1", "replace") * n)) for i, v in enumerate(ODD) for n in (0, 1, 3)],
        "lang string, content binary",
    )
    plain = rows.select("lang", F.col("content").cast("string").alias("value"))
    plain.write.partitionBy("lang").option("maxRecordsPerFile", 1).option("lineSep", "|").text(f"{tmp_path}/a")
    ended = rows.withColumn("content", F.concat("content", F.lit(bytearray(b"|"))))
    for _ in range(2):  # again, as after a lost task: no file twice
        assert folders.write_each(ended, f"file:{tmp_path}/b", "lang") == len(ODD) * 3
        assert contents(f"{tmp_path}/b") == contents(f"{tmp_path}/a")


def test_an_empty_table_leaves_an_empty_folder(spark, tmp_path):
    none = spark.createDataFrame([], "lang string, content binary")
    assert folders.write_each(none, f"{tmp_path}/none", "lang") == 0
    assert os.listdir(f"{tmp_path}/none") == []


def test_documents_become_files_without_a_commit_file_by_file(spark, tmp_path):
    docs = [(i, f"t{i}\r", ["en", None, "de"][i % 3]) for i in range(300)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    assert read_files_decode(spark, str(tmp_path)).groupBy("bundle").count().count() == 2
    (made,) = [d for d in set(os.listdir(shared)) - before if d.startswith("files-")]
    left = [n for _, _, names in os.walk(f"{shared}/{made}") for n in names]
    assert len(left) == 300 and all(n.endswith(".txt") for n in left)  # no check sums, no success mark
