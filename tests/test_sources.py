"""Readers and writers on small files."""

from __future__ import annotations

import gzip

from pyspark.sql import functions as F

from tessella.sources import sinks, text
from tessella.streaming import sentences as streaming


def test_corpus_and_alignments(spark, tmp_path):
    (tmp_path / "c.txt").write_text("das haus ||| the house\n\n ||| x\n")
    (tmp_path / "a.txt").write_text("0-0 1-1 1-2\n\n0-0\n")
    got = {r.sent_id: (r.src, r.tgt) for r in text.corpus(spark, str(tmp_path / "c.txt")).collect()}
    assert got == {0: (["das", "haus"], ["the", "house"]), 1: ([], []), 2: ([], ["x"])}
    links = sorted(tuple(r) for r in text.alignments(spark, str(tmp_path / "a.txt")).collect())
    assert links == [(0, 0, 0, 0), (0, 1, 1, 1), (0, 2, 1, 2), (2, 0, 0, 0)]


def test_sentence_grammars(spark, tmp_path):
    for n in (0, 12):
        with gzip.open(tmp_path / f"grammar.{n}.gz", "wt") as f:
            f.write(f"haus ||| house ||| 1-1\nx{n} ||| y ||| 0-2\n")
    got = sorted(tuple(r) for r in text.sentence_grammars(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "haus", "house", 1, 1), (0, 1, "x0", "y", 0, 2), (12, 0, "haus", "house", 1, 1), (12, 1, "x12", "y", 0, 2)]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 2\na 3 4\nb 0 0\n")
    got = {r.key: r.v for r in text.skipgram_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 0.0], "<s>": [0.0, 0.0]}
    (tmp_path / "p.txt").write_text("2 2\na ||| x\t3 4\na ||| <UNK>\t1 0\nz ||| x\t1 0\n")
    known = spark.createDataFrame([("a", "x")], "src string, tgt string")
    assert [(r.src, r.tgt, r.v) for r in text.phrase_vectors(spark, str(tmp_path / "p.txt"), known, known).collect()] == [("a", "x", [0.6, 0.8])]


def test_lm_groups(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a ||| x ||| the x </s>\na ||| y ||| the y\n\nb ||| z ||| z\n\n")
    (tmp_path / "s.txt").write_text("p -6\np -3\np 0\np -1\np 0\n")
    got = sorted(tuple(r) for r in text.lm_groups(spark, str(tmp_path / "p.txt"), str(tmp_path / "s.txt")).collect())
    assert got == [(0, "x", 2.0), (0, "y", 1.5), (1, "z", 1.0)]


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("the \n\nof\nthe\n")
    assert sorted(r.word for r in text.word_list(spark, str(tmp_path / "w.txt")).collect()) == ["of", "the"]


def test_sinks(spark, tmp_path):
    rules = spark.createDataFrame([(1, "[X] ||| a ||| b ||| "), (1, "[X] ||| c ||| d ||| "), (2, "[X] ||| a ||| b ||| ")], "sent_id long, line string")
    sinks.write_sentence_grammars(rules, str(tmp_path / "g"))
    assert sorted(f.name for f in (tmp_path / "g").iterdir() if not f.name.startswith(".")) == ["grammar.1.gz", "grammar.2.gz"]
    with gzip.open(tmp_path / "g" / "grammar.1.gz", "rt") as f:
        assert sorted(f.read().splitlines()) == ["[X] ||| a ||| b ||| ", "[X] ||| c ||| d ||| "]
    phrases = spark.createDataFrame([(3, "haus ||| house ||| 1-1"), (14, "a b ||| c ||| 0-1")], "sent_id long, line string")
    sinks.write_sentence_grammars(phrases, str(tmp_path / "p"))
    again = sorted(tuple(r) for r in text.sentence_grammars(spark, str(tmp_path / "p")).collect())
    assert again == [(3, 0, "haus", "house", 1, 1), (14, 0, "a b", "c", 0, 1)]
    assert sorted(r.line for r in sinks.merged_grammar(rules).collect()) == sorted(["[X] ||| a ||| b ||| ", "[X] ||| c ||| d ||| ", "[X] ||| [X,1] [X,2] ||| [1] [2] ||| Glue=1", "[X] ||| [X,1] [X,2] ||| [2] [1] ||| Glue=1 Inverse=1", "[S] ||| [X,1] ||| [1] ||| 0"])
    line = spark.range(1).select(sinks.sgml_segment(F.lit(3), F.lit("a b"), F.lit("c"), "out")).first()[0]
    assert line == '<seg grammar="out/grammar.3.gz" id="3">a b ||| c</seg>'
    sinks.save_tables({"rules": rules}, str(tmp_path / "m"))
    assert sinks.load_tables(spark, str(tmp_path / "m"), ["rules"])["rules"].count() == 3
    svm = spark.range(1).select(sinks.libsvm_line(F.lit(1), F.array(F.lit(4), F.lit(0)), F.array(F.lit(2.0), F.lit(1.0)))).first()[0]
    assert svm == "1 1:1.0 5:2.0"


def test_streamed_sentences(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.txt").write_text("0\ta b\n1\tzz\n")
    inventory = spark.createDataFrame([("a", "A")], "src string, tgt string")
    query = streaming.decode_stream(spark, str(tmp_path / "in"), inventory, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.sent_id, r.i, r.j, r.src, r.tgt) for r in got.collect()) == [(0, 0, 1, "a", "A"), (0, 1, 2, "b", "<unk>"), (1, 0, 1, "zz", "<unk>")]


def test_lines_of_many_blocks_are_numbered(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 13) for k in range(400)]
    (tmp_path / "l.txt").write_text("\n".join(lines) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = text.numbered_lines(spark, str(tmp_path / "l.txt"))
        assert spark.read.text(str(tmp_path / "l.txt")).rdd.getNumPartitions() > 3
        assert sorted(tuple(r) for r in got.collect()) == list(enumerate(lines))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
