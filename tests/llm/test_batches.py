import pytest
from cases import documents

from bindery.llm import fuzzy_lines, grouped_prefix, suffix_array_dedup
from bindery.llm.rows import BATCH_BYTES, BATCH_SETTING


@pytest.mark.parametrize("run", [fuzzy_lines.digest, grouped_prefix.digest, suffix_array_dedup.digest])
def test_python_is_sent_texts_by_bytes(spark, run):
    spark.conf.unset(BATCH_SETTING)
    docs = documents(spark, [(i, f"{i} some words of a text") for i in range(9)])
    assert run(docs).count() == 9
    assert int(spark.conf.get(BATCH_SETTING).rstrip("b")) == BATCH_BYTES
    spark.conf.set(BATCH_SETTING, 1 << 20)
    assert run(docs).count() == 9
    assert int(spark.conf.get(BATCH_SETTING).rstrip("b")) == 1 << 20
    spark.conf.unset(BATCH_SETTING)
