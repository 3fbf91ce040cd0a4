"""Relative frequencies and grammar features of phrase pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import printed, tokens
from .counting import top_targets

MISSING = 99.0


def relative_frequencies(counts: DataFrame) -> DataFrame:
    """log10 P(tgt | src) and log10 P(src | tgt), over all pairs. Totals are aggregates joined back, so a frequent side isn't one window."""
    by_src = counts.groupBy("src").agg(F.sum("n").alias("src_n"))
    by_tgt = counts.groupBy("tgt").agg(F.sum("n").alias("tgt_n"))
    rows = counts.join(by_src, "src").join(by_tgt, "tgt")
    return rows.select("src", "tgt", "n", F.log10(F.col("n") / F.col("src_n")).alias("log_e_f"), F.log10(F.col("n") / F.col("tgt_n")).alias("log_f_e"))


def rule_features(counts: DataFrame, add_one: bool = True) -> DataFrame:
    """EgivenF, SampleCountF, CountEF, IsSingletonF, IsSingletonFE of every pair."""
    totals = counts.groupBy("src").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    more = 1 if add_one else 0
    return counts.join(totals, "src").select(
        "src",
        "tgt",
        (-F.log10(F.col("n") / F.col("total"))).alias("e_given_f"),
        F.log10(F.col("total") + more * F.col("types")).alias("sample_count_f"),
        F.log10(F.col("n") + more).alias("count_ef"),
        (F.col("total") == 1).cast("int").alias("is_singleton_f"),
        (F.col("n") == 1).cast("int").alias("is_singleton_fe"),
    )


def lexical_table(counts: DataFrame) -> DataFrame:
    """(f, e, p_ef, p_fe): word translation probabilities as relative frequencies, both directions; totals are joined back."""
    by_src = counts.groupBy("src").agg(F.sum("n").alias("src_n"))
    by_tgt = counts.groupBy("tgt").agg(F.sum("n").alias("tgt_n"))
    rows = counts.join(by_src, "src").join(by_tgt, "tgt")
    return rows.select(F.col("src").alias("f"), F.col("tgt").alias("e"), (F.col("n") / F.col("src_n")).alias("p_ef"), (F.col("n") / F.col("tgt_n")).alias("p_fe"))


def _max_lexical(pairs: DataFrame, table: DataFrame, given: str, word: str, p: str, out: str) -> DataFrame:
    """Sum over the words of one side of -log10 of their best probability with a word of the other side."""
    over, under = ("src", "tgt") if word == "e" else ("tgt", "src")
    each = pairs.select("src", "tgt", F.posexplode(tokens(F.col(under))).alias("k", word), tokens(F.col(over)).alias("others"))
    each = each.withColumn(given, F.explode(F.array_union("others", F.array(F.lit("NULL")))))
    best = each.join(table.select("f", "e", F.col(p).alias("p")), ["f", "e"], "left").groupBy("src", "tgt", "k").agg(F.max("p").alias("p"))
    return best.groupBy("src", "tgt").agg(F.sum(F.when(F.col("p") > 0, -F.log10("p")).otherwise(MISSING)).alias(out))


def lexical_features(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """MaxLexEgivenF and MaxLexFgivenE; a word without any probability adds 99, and a feature that reaches 99 is null."""
    unique = pairs.select("src", "tgt").distinct()
    e_f = _max_lexical(unique, table, "f", "e", "p_ef", "max_lex_e_f")
    f_e = _max_lexical(unique, table, "e", "f", "p_fe", "max_lex_f_e")
    kept = lambda c: F.when(F.col(c) < MISSING, F.col(c)).alias(c)
    return e_f.join(f_e, ["src", "tgt"]).select("src", "tgt", kept("max_lex_e_f"), kept("max_lex_f_e"))


def featurised_rules(rules: DataFrame, counts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds ``line`` to ``rules(sent_id, lhs, src, tgt, features)``: grammar lines with their features.

    Sources ``<unk>`` take the word of the target side. Rules with a non-terminal, unknown words and PassThrough rules get
    no features from counts; a pair without counts gets none either. Lexical features are left out for PassThrough rules
    alone, and where a word without any probability brings them to 99.
    """
    unknown = F.col("src") == "<unk>"
    fixed = rules.withColumn("unknown", unknown).withColumn("src", F.when(unknown, F.col("tgt")).otherwise(F.col("src")))
    passes = F.coalesce(F.col("features") == "PassThrough=1", F.lit(False))
    plain = ~F.col("unknown") & ~passes & ~F.concat_ws(" ", "src", "tgt").rlike(r"\[[^\]]*\]")
    out = fixed.join(rule_features(counts), ["src", "tgt"], "left")
    shown = [
        F.when(F.col("e_given_f") == 0, F.lit("EgivenF=-0.0")).otherwise(F.concat(F.lit("EgivenF="), printed(F.col("e_given_f"), "%.11f"))),
        *(F.concat(F.lit(f"{name}="), printed(F.col(c), spec)) for name, c, spec in (("SampleCountF", "sample_count_f", "%.11f"), ("CountEF", "count_ef", "%.11f"), ("IsSingletonF", "is_singleton_f", "%d"), ("IsSingletonFE", "is_singleton_fe", "%d"))),
    ]
    parts = [F.when(plain & F.col("e_given_f").isNotNull(), x) for x in shown]
    if table is not None:
        out = out.join(lexical_features(fixed.where(~passes), table), ["src", "tgt"], "left")
        parts += [F.when(~passes & F.col(c).isNotNull(), F.concat(F.lit(f"{name}="), printed(F.col(c), "%.11f"))) for name, c in (("MaxLexFgivenE", "max_lex_f_e"), ("MaxLexEgivenF", "max_lex_e_f"))]
    return out.withColumn("line", F.concat_ws(" ||| ", "lhs", "src", "tgt", F.concat_ws(" ", "features", *parts)))


def filtered_rules(rules: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Rules whose pair is among the ``k`` most frequent of its source."""
    return rules.join(top_targets(counts, k).select("src", "tgt"), ["src", "tgt"], "left_semi")
