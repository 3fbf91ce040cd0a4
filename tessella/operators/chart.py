"""Chart over source spans, and grammar emission.

With every single word provable (a phrase or ``<unk>``) and a glue rule that joins any two neighbours, every span is
provable. The chart therefore has one node per span, an edge per phrase found, an ``<unk>`` edge per word that is no
phrase, and a binary edge per split of a span: plain joins and explodes instead of a bottom-up search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR
from . import scoring


def escaped(words):
    """Words that would read as non-terminals (``[…]`` at their beginning) get a backslash."""
    return F.transform(words, lambda w: F.when(w.rlike(r"^\[[^\]]*\]"), F.concat(F.lit("\\"), w)).otherwise(w))


def nodes(sentences: DataFrame) -> DataFrame:
    """(sent_id, i, j): every span, i inclusive, j exclusive."""
    n = F.size("words")
    starts = sentences.where(n > 0).select("sent_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    return starts.select("sent_id", "i", F.explode(F.sequence(F.col("i") + 1, F.col("n"))).alias("j"))


def lengths(sentences: DataFrame) -> DataFrame:
    """(sent_id, words): for each number of words that occurs one sentence of as many, numbered by it.

    Nodes, binary edges and glue rules hold positions only: sentences of one length have the same ones, so what is counted
    of them is counted once a length and given to its sentences by ``of_length``.
    """
    n = F.size("words")
    return sentences.where(n > 0).select(n.alias("sent_id")).distinct().select("sent_id", F.array_repeat(F.lit(""), F.col("sent_id")).alias("words"))


def of_length(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """``found(sent_id, …)`` of ``lengths`` for the sentences themselves. D lengths take D * D / 2 words: a small table."""
    rows = sentences.select("sent_id", F.size("words").alias("n_words"))
    return rows.join(F.broadcast(found.withColumnRenamed("sent_id", "n_words")), "n_words").drop("n_words")


def dealt_nodes(sentences: DataFrame) -> DataFrame:
    """``nodes`` of few sentences, dealt over all tasks by where they begin, as a long one has most of the edges."""
    parts = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes(sentences).repartition(parts, "sent_id", "i")


def span_phrases(sentences: DataFrame, longest: int) -> DataFrame:
    """(sent_id, i, j, src) of all spans of at most ``longest`` words."""
    n = F.size("words")
    starts = sentences.where(n > 0).select("sent_id", "words", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    spans = starts.select("sent_id", "words", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("i") + longest, F.size("words")))).alias("j"))
    return spans.select("sent_id", "i", "j", F.array_join(F.slice("words", F.col("i") + 1, F.col("j") - F.col("i")), " ").alias("src"))


def longest_source(inventory: DataFrame) -> int:
    """Words of the longest source phrase: one number for the span bound."""
    return int(inventory.agg(F.coalesce(F.max(F.size(F.split("src", " "))), F.lit(1))).first()[0])


def lexical_edges(spans: DataFrame, inventory: DataFrame) -> DataFrame:
    """Spans whose words are a source phrase, with all its targets."""
    return spans.join(inventory.select("src", "tgt").distinct(), "src").select("sent_id", "i", "j", "src", "tgt")


def unknown_edges(spans: DataFrame, inventory: DataFrame) -> DataFrame:
    """Single words that aren't a source phrase themselves."""
    return spans.where("j = i + 1").join(inventory.select("src").distinct(), "src", "left_anti").select("sent_id", "i", "j", "src")


def binary_edges(spans: DataFrame) -> DataFrame:
    """(sent_id, i, k, j) for every split of every node: as many as there are triples, so pass short sentences."""
    return spans.where("j > i + 1").select("sent_id", "i", F.explode(F.sequence(F.col("i") + 1, F.col("j") - 1)).alias("k"), "j")


def symbol(i, j, plain: bool = False):
    return F.lit("[X]") if plain else F.concat(F.lit("[X_"), i.cast("string"), F.lit("_"), j.cast("string"), F.lit("]"))


def glue_rules(edges: DataFrame, plain: bool = False) -> DataFrame:
    """Both orders of every binary edge."""
    i, k, j = F.col("i"), F.col("k"), F.col("j")
    head = F.concat(symbol(i, j, plain), F.lit(SEPARATOR), symbol(i, k, plain), F.lit(" "), symbol(k, j, plain), F.lit(SEPARATOR))
    lines = F.array(F.concat(head, F.lit("[1] [2] ||| Glue=1")), F.concat(head, F.lit("[2] [1] ||| Glue=1 Inverse=1")))
    return edges.select("sent_id", F.explode(lines).alias("line"))


def unknown_rules(edges: DataFrame, plain: bool = False) -> DataFrame:
    return edges.select("sent_id", F.concat_ws(SEPARATOR, symbol(F.col("i"), F.col("j"), plain), F.lit("<unk>"), "src", F.lit("PassThrough=1")).alias("line"))


def copy_rules(edges: DataFrame, plain: bool = False) -> DataFrame:
    """Known single words may also pass through as they are."""
    known = edges.where("j = i + 1").select("sent_id", "i", "j", "src").distinct()
    return known.select("sent_id", F.concat_ws(SEPARATOR, symbol(F.col("i"), F.col("j"), plain), "src", "src", F.lit("PassThrough=1")).alias("line"))


def top_rules(sentences: DataFrame) -> DataFrame:
    n = F.size("words").cast("string")
    return sentences.where(F.size("words") > 0).select("sent_id", F.concat(F.lit("[S] ||| [X_0_"), n, F.lit("] ||| [1] ||| 0")).alias("line"))


def scored_rules(scored: DataFrame, plain: bool = False, normalise: str = "none", only_positive: bool = False, log: bool = False, rank: bool = False, **shown: bool) -> DataFrame:
    """(sent_id, line) of ``scored(sent_id, i, j, src, tgt, score)``: the candidates of each span normalised and ranked
    among themselves, then printed. ``shown`` are the options of ``scoring.rule_line``."""
    out = scoring.post_processed(scored, ["sent_id", "i", "j"], normalise, only_positive, log, rank)
    lines = scoring.rule_line(out.withColumn("lhs", symbol(F.col("i"), F.col("j"), plain)), log=log, **shown)
    return lines.select("sent_id", "line")


def failures(sentences: DataFrame) -> DataFrame:
    """Sentences without a node over all their words; as every span is provable, these are the empty ones."""
    return sentences.where(F.coalesce(F.size("words"), F.lit(0)) <= 0).select("sent_id")


def word_rules(sentences: DataFrame, inventory: DataFrame, scored_lines: DataFrame | None = None) -> DataFrame:
    """The lines that depend on the words, each once a sentence: unknown words, copies, top rules and, if given, the scored rules."""
    words = sentences.withColumn("words", escaped(F.col("words")))
    spans = span_phrases(words, longest_source(inventory))
    lines = unknown_rules(unknown_edges(spans, inventory)).unionByName(copy_rules(lexical_edges(spans, inventory))).unionByName(top_rules(words))
    if scored_lines is not None:
        lines = lines.unionByName(scored_lines.select("sent_id", "line"))
    return lines.distinct()


def grammar(sentences: DataFrame, inventory: DataFrame, scored_lines: DataFrame | None = None) -> DataFrame:
    """All lines of all sentences' grammars: glue rules and ``word_rules``.

    Glue lines are as many as word triples and different by construction; only the others are looked at for repeats.
    """
    return glue_rules(binary_edges(nodes(sentences))).unionByName(word_rules(sentences, inventory, scored_lines))
