"""Writers: per-sentence grammars, merged grammar, SGML, sparse training files, model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules that every merged grammar ends with.
GLUE = ["[X] ||| [X,1] [X,2] ||| [1] [2] ||| Glue=1", "[X] ||| [X,1] [X,2] ||| [2] [1] ||| Glue=1 Inverse=1", "[S] ||| [X,1] ||| [1] ||| 0"]


def write_sentence_grammars(rules: DataFrame, folder: str) -> None:
    """One gzip text file ``grammar.{n}.gz`` per sentence; all rules of a sentence meet in one task.

    Sentences are written in parallel; giving the files their names is one rename each on the driver.
    """
    spark = rules.sparkSession
    staged = f"{folder}/_staged"
    thin = rules.select("sent_id", "line").repartition("sent_id").sortWithinPartitions("sent_id", "line")
    thin.write.mode("overwrite").partitionBy("sent_id").option("compression", "gzip").text(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for sentence in fs.listStatus(path(staged)):
        name = sentence.getPath().getName()
        if name.startswith("sent_id="):
            target = path(f"{folder}/grammar.{name.removeprefix('sent_id=')}.gz")
            fs.delete(target, False)
            # one task wrote the sentence, so there is one file
            fs.rename(fs.globStatus(path(f"{staged}/{name}/part-*"))[0].getPath(), target)
    fs.delete(path(staged), True)


def merged_grammar(rules: DataFrame) -> DataFrame:
    """Distinct rule lines of all sentences and the glue rules."""
    glue = rules.sparkSession.createDataFrame([(g,) for g in GLUE], "line string")
    return rules.select("line").distinct().unionByName(glue).distinct()


def sgml_segment(sent_id: Column, src: Column, tgt: Column, folder: str) -> Column:
    """``<seg grammar="…" id="n">src ||| tgt</seg>``, the form in which decoders take their input."""
    n = sent_id.cast("string")
    return F.concat(F.lit(f'<seg grammar="{folder}/grammar.'), n, F.lit('.gz" id="'), n, F.lit('">'), src, F.lit(" ||| "), tgt, F.lit("</seg>"))


def sparse_line(label: Column, names: Column, values: Column) -> Column:
    """``label | name:value …`` with the entries of two parallel arrays."""
    entries = F.zip_with(names.cast("array<string>"), values.cast("array<string>"), lambda n, v: F.concat(n, F.lit(":"), v))
    return F.concat_ws(" | ", label.cast("string"), F.array_join(entries, " "))


def libsvm_line(label: Column, ids: Column, values: Column) -> Column:
    """``label id:value …`` with ids from 1 in ascending order."""
    entries = F.array_sort(F.arrays_zip(ids.alias("i"), values.alias("v")))
    return F.concat_ws(" ", label.cast("string"), F.array_join(F.transform(entries, lambda e: F.concat((e["i"] + 1).cast("string"), F.lit(":"), e["v"].cast("string"))), " "))


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A model is its tables: one parquet folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
