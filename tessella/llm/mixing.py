"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear between knots. Integrating it gives the
source's cumulative token demand; its documents, in a fixed pseudo-random order and repeated as the target asks, fill
that demand, and inverting the demand at the middle of a copy's tokens gives its training position. Copies are then
range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, parts, row_tag

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``at``: the place of the distinct ``key`` among all, from 0, null last. Range partitions and their counts; no task gets all rows."""
    order = F.col(key).asc_nulls_last()
    dealt = durable(rows.repartitionByRange(parts(rows.sparkSession), order).withColumn("slice", F.spark_partition_id()))
    # as many rows as there are slices
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("slice").orderBy(order)) - 1
    return dealt.withColumn("at", inside).join(offsets, "slice").withColumn("at", F.col("at") + F.col("offset")).drop("slice", "offset")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources in code-point order, null last, take ``weights`` in turn and share all words by weight; a target stops at
    ``most`` times its source's size and the excess is shared again by weight until none is above. The water level of
    those below their caps rises from round to round, each one sum over the sources, until no more of them are capped.
    """
    by_source = in_order(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("source_size") * F.lit(float(most))
    weighted = durable(by_source.select("source", "source_size", F.element_at(turn, (F.col("at") % len(weights) + 1).cast("int")).alias("weight"), cap.alias("cap")))
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        n, size, spent, open_weight = weighted.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == capped:
            break
        capped, level = n, (size - spent) / open_weight if open_weight else float("inf")
    return weighted.select("source", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def linear_curriculum(targets: DataFrame, tilt: float = 0.5) -> DataFrame:
    """Adds ``knots``, the schedule as (t, w): heavier sources run above their mean at first and below it at the end.

    The tilts of all sources, weighted by their targets, cancel out, so that weights sum to one at every time.
    """
    whole, top = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.max("weight")).first()
    heavy = (F.col("weight") >= F.lit(top)).cast("double")
    at_top = targets.agg(F.coalesce(F.sum(heavy * F.col("target")), F.lit(0.0))).first()[0]
    share = F.col("target") / F.lit(whole) if whole else F.lit(0.0)
    slope = F.lit(tilt) * (heavy - F.lit(at_top / whole if whole else 0.0))
    ends = F.array(F.struct(F.lit(0.0).alias("t"), (share * (1 + slope)).alias("w")), F.struct(F.lit(1.0).alias("t"), (share * (1 - slope)).alias("w")))
    return targets.withColumn("knots", ends)


def demand(knots: Column) -> Column:
    """Array of cumulative demand at each knot (trapezia), from 0."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size(knots) - 1),
        lambda i: (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]) * (F.element_at(knots, i + 1)["w"] + F.element_at(knots, i)["w"]) / 2,
    )
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def position(knots: Column, filled: Column, share: Column) -> Column:
    """Time at which a source with cumulative demand ``filled`` has had ``share`` (0..1) of its whole demand."""
    asked = share * F.element_at(filled, -1)
    last = F.size(knots) - 1
    i = F.greatest(F.lit(1), F.least(last, F.size(F.filter(filled, lambda c: c <= asked))))
    a, b = F.element_at(knots, i), F.element_at(knots, i + 1)
    span = b["t"] - a["t"]
    rest = F.greatest(F.lit(0.0), asked - F.element_at(filled, i))
    # rest = w_a x + (w_b - w_a) x^2 / (2 span), in the form of the quadratic formula that also holds for a flat schedule
    bend = F.try_divide(b["w"] - a["w"], span)
    root = F.sqrt(F.greatest(F.lit(0.0), a["w"] * a["w"] + 2 * bend * rest))
    return F.least(b["t"], a["t"] + F.coalesce(F.try_divide(2 * rest, a["w"] + root), F.lit(0.0)))


def _dealt(docs: DataFrame, weights: tuple[int, ...], most: float, tilt: float, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """The rows of ``mix`` without positions, and the training time of a row's copy ``p`` (from 0) as a column."""
    spark = docs.sparkSession
    buckets = max(1024, 8 * parts(spark))
    keys = ["source", "doc_id", "size", "tag"]
    thin = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), row_tag(docs[id_col], docs[text_col]).alias("tag"))
    # rows that repeat all of this stand side by side, so that they are one row until the end
    order = F.xxhash64("tag", F.lit(seed))
    sizes = durable(thin.groupBy(*keys).agg(F.count("*").alias("same")).select("*", (F.col("size") * F.col("same")).alias("all_size"), order.alias("h"), F.pmod(order, F.lit(buckets)).cast("int").alias("bucket")))
    totals = linear_curriculum(durable(source_targets(sizes.select("source", F.col("all_size").alias("size")), weights, most)), tilt)
    per_bucket = sizes.groupBy("source", "bucket").agg(F.sum("all_size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    plan = starts.alias("s").join(totals.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.bucket", "offset", "source_size", "target", "knots", demand(F.col("knots")).alias("filled"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "tag").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("all_size").over(inside), F.lit(0)))
    one_each = ahead.withColumn("start", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("same")), lambda k: F.col("ahead") + (k - 1) * F.col("size"))))
    rows = one_each.alias("d").join(plan.alias("p"), (F.col("d.bucket") == F.col("p.bucket")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    # a hair above a whole number of passes is rounding, not demand
    full = F.floor(ratio + 1e-9)
    left = F.col("target") - full * F.col("source_size")
    begin = F.col("offset") + F.col("start")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.least(F.lit(int(most)), full + (begin + F.col("size") / 2 < left).cast("long"))).cast("int")

    def when(p: Column) -> Column:
        middle = F.coalesce(F.try_divide(p * F.col("source_size") + F.col("begin") + F.col("size") / 2, "target"), F.lit(0.0))
        return position(F.col("knots"), F.col("filled"), F.least(F.lit(1.0), middle))

    return rows.select("d.doc_id", "d.source", "size", "tag", "source_size", "target", "knots", "filled", begin.alias("begin"), copies.alias("copies")), when


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, tilt: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row: doc_id, source, size, source_size, target, copies, taken, positions.

    ``copies`` is how often the mix takes the document (whole passes over its source, then one more for the documents
    whose middle lies in what is left), ``taken`` the words of all copies, ``positions`` the training time of every
    copy. Rows are range-sorted by the first of these, documents that aren't taken first. Null text and null source are
    legal: size 0, and a source of their own that comes last. The order inside a source hashes doc_id and text, so
    reruns agree; rows that repeat both are interchangeable. An empty table gives no rows. Running totals are two-level
    (hash buckets, then rows), so a hot source or identifier is spread over all tasks; what reaches the driver are sums.
    """
    rows, when = _dealt(docs, weights, most, tilt, seed, id_col, text_col, source_col)
    passes = F.filter(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda p: p < F.col("copies"))
    taken = (F.col("size") * F.col("copies")).cast("long")
    out = durable(rows.select("doc_id", "source", "size", "source_size", "target", "copies", taken.alias("taken"), F.transform(passes, when).alias("positions")))
    first = F.try_element_at("positions", F.lit(1))
    return out.repartitionByRange(parts(docs.sparkSession), first, "doc_id").sortWithinPartitions(first, "doc_id")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, tilt: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, range-sorted by the training position of every copy.

    Copy ``p`` lies ``p`` times its source's size further on in the source's demand than the first.
    """
    rows, when = _dealt(docs, weights, most, tilt, seed, id_col, text_col, source_col)
    copies = rows.where("copies > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    plan = copies.select(F.col("tag").alias("k"), "p", when(F.col("p")).alias("position")).groupBy("k", "p").agg(F.min("position").alias("position"))
    wide = docs.select(F.struct("*").alias("row"), row_tag(docs[id_col], docs[text_col]).alias("tag"))
    joined = wide.join(plan, F.col("tag") == F.col("k"))
    return joined.repartitionByRange(parts(docs.sparkSession), "position", "tag").sortWithinPartitions("position", "tag").select("row.*")
