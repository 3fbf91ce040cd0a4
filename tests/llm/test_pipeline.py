"""The pipeline's stages on the small tables: each on what its predecessor kept."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest

from test_keep_one import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipe

    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs, kept = given, {}
    for name, stage in pipe.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packed" or docs.columns == given.columns
    rows = {n: Counter(r.doc_id for r in d.select("doc_id").collect()) for n, d in kept.items()}
    text = {r.doc_id: r.text for r in given.collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in text.items()}
    first: dict = {}
    for i in sorted(rows["language"]):
        first.setdefault(norm[i], i)
    assert rows["exact"] == Counter(first.values())
    order = sorted(rows["exact"])
    stays = {order[k] for k in brute([text[i] or "" for i in order])}
    assert rows["near"] == Counter(stays)
    assert set(rows["mixed"]) <= stays and max(rows["mixed"].values()) <= 3
    whole = Counter()
    for r in kept["packed"].collect():
        whole[r.doc_id] += r.length / r.doc_tokens
    assert {i: round(x, 6) for i, x in whole.items()} == dict(rows["mixed"])


ROWS = "doc_id long, text string, lang string, source string, n_chars int"


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipe

    prose = " ".join("the quick brown fox jumps over a lazy dog and runs away from it".split() * 6)
    other = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    rows = [(1, prose, "en", "a", 0), (2, prose, "en", "a", 0), (2, prose, "en", "a", 0), (None, prose.upper(), "en", None, 0), (None, other, "en", "b", 0), (None, other, "en", "b", 0), (3, None, None, None, 0), (4, "", "en", "a", 0), (5, "!!", "en", "a", 0)]
    df = spark.createDataFrame(rows, ROWS)
    kept = pipe.exact(spark, df, "")
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, prose), (None, prose.upper()), (None, other), (3, None), (5, "!!")])
    near = pipe.near(spark, kept, "")
    assert Counter(r.text for r in near.collect()) == Counter([prose, other, None, "!!"])
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in pipe.STAGES:
            docs = stage(spark, docs, "")
            assert name == "packed" or docs.columns == df.columns
        assert (docs.count() == 0) == table.isEmpty()


def test_run_predicts_each_language_once(spark, tmp_path, monkeypatch):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipe

    asked = spark.sparkContext.accumulator(0)

    def counted(_, docs, __):
        from pyspark.sql import functions as F
        from pyspark.sql.types import LongType

        def see(x):
            asked.add(len(x))
            return x

        return docs.withColumn("doc_id", F.pandas_udf(see, LongType())("doc_id"))

    docs = spark.createDataFrame([(k, f"word{k} and some more words {k}", "en", "a", 0) for k in range(30)], ROWS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipe, "STAGES", [("seen", counted), *pipe.STAGES[1:]])
    pipe.run(spark, str(tmp_path)).collect()
    assert asked.value == 30
