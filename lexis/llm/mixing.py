"""Operator 10: mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, own

#: Weight schedules at equally spaced training times from 0 to 1, linear in between, taken in turn by the sources'
#: weight class: sources of weight 1 fade out, those of weight 2 stay level, those of weight 3 grow.
CURRICULUM = ((3.0, 2.0, 1.0), (1.0, 1.0, 1.0), (1.0, 2.0, 3.0))


def time_of(share: Column, schedule: tuple[float, ...]) -> Column:
    """The training time (0 to 1) at which a source of this schedule has been asked for `share` of its tokens.

    The schedule's integral is quadratic between two knots; the knot before is found and the quadratic inverted.
    """
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    total, done, out = sum(areas), 0.0, None
    for i, area in enumerate(areas):
        a, b = schedule[i], schedule[i + 1]
        rest = F.greatest(share * total - done, F.lit(0.0))
        slope = (b - a) / step
        inside = rest / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))) - a) / slope
        at = F.least(F.lit(i * step) + inside, F.lit((i + 1) * step))
        out = at if out is None else F.when(share * total >= done, at).otherwise(out)
        done += area
    return out


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Targets of sources (rows `missing`, `source`, `source_size`): min(most * size, weight * level).

    Sharing the excess of full sources by weight until none is above its bound ends at one common level. The
    sources are sorted by the level at which they fill; the level is the first one that the sources after it share.
    One row per source is sorted here, in one task that spills; documents are not.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy("missing", "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sized = ranked.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    filled = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    levels = (
        sized.withColumn("full", F.coalesce(F.sum("bound").over(filled), F.lit(0)))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("open_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open_weight").cast("double"))
    )
    fits = F.col("level") <= F.col("bound").cast("double") / F.col("weight")
    level = F.max(F.struct(F.when(fits, 1).otherwise(0).alias("ok"), (-F.col("full")).alias("order"), F.col("level").alias("v"))).over(every)
    return levels.withColumn("common", level["v"]).select(
        "missing", "source", "rank", "weight", "source_size", F.col("total").alias("all_words"),
        F.least(F.col("bound").cast("double"), F.col("weight") * F.col("common")).alias("target"),
    )


def prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, digits: int, seed: int, *carried) -> DataFrame:
    """Id, source, size in words, and the place in the fixed pseudo-random order of every row: `mix`, a digest of id and
    size, of which the leading `digits` make the `bucket`."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"), *carried)
    mix = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("size").cast("string"), F.lit(str(seed))))
    return rows.withColumn("mix", mix).withColumn("bucket", F.left("mix", F.lit(digits)))


def placed(rows: DataFrame, parts: DataFrame, curriculum: tuple[tuple[float, ...], ...]) -> DataFrame:
    """Rows with `source_size`, `target`, `copies` and `positions`; `parts` has `part_size` by source and bucket.

    Prefix sums run over the parts of a source, and within each part; rows and sums meet in one exchange by part.
    """
    targets = source_targets(parts.groupBy("missing", "source").agg(F.sum("part_size").alias("source_size")))
    earlier = Window.partitionBy("missing", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("base", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).join(targets, ["missing", "source"]).drop("part_size")
    within = Window.partitionBy("missing", "source", "bucket").orderBy("mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["missing", "source", "bucket"])
    start, most = F.col("base") + F.col("inside"), 3

    def begins(k: int) -> Column:
        return (start + k * F.col("source_size")).cast("double")

    taken = [F.when((F.col("size") > 0) & (begins(k) + F.col("size") / 2 < F.col("target")), 1).otherwise(0) for k in range(most)]

    def position(k: int) -> Column:
        share = F.least(F.try_divide(begins(k), F.col("target")), F.lit(1.0))
        at = time_of(share, curriculum[-1])
        for c in range(len(curriculum) - 1):
            at = F.when(F.col("rank") % len(curriculum) == c, time_of(share, curriculum[c])).otherwise(at)
        return at * F.col("all_words")

    return laid.withColumn("copies", sum(taken, F.lit(0)).cast("int")).withColumn("positions", F.slice(F.array(*[position(k) for k in range(most)]), F.lit(1), F.col("copies")))


def curriculum_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum: tuple[tuple[float, ...], ...] = CURRICULUM, digits: int = 3, seed: int = 17) -> DataFrame:
    """How many words the mix takes of each row, and where in training it stands.

    A source's documents are laid out in a fixed pseudo-random order, as often as its target needs; a copy is taken
    whole if its middle lies before the target, so a source misses its target by half a document at most. A copy's
    offset, as a share of the target, is inverted through the integral of the source's weight schedule to its training
    position.

    Returns id, `size` (words), `source_size`, `target`, `taken`, `copies` and `positions` (ascending, in words of the
    whole mix), range-sorted by first position, rows not taken last. A null source is a source of its own, after all
    others. Rows without words are taken 0 times. Repeated rows count each. Reruns agree: the order depends on id and
    size alone, and rows equal in both are interchangeable. An empty table gives no rows; other columns are ignored;
    long texts are counted whole. Prefix sums run in 16^digits parts per source, so no source meets in one task.
    """
    rows = materialise(prepared(docs, id_col, text_col, source_col, digits, seed), "mix-rows")
    parts = materialise(rows.groupBy("missing", "source", "bucket").agg(F.sum("size").alias("part_size")), "mix-parts")
    mixed = placed(rows, parts, curriculum)
    return mixed.select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "positions",
    ).orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), id_col)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", curriculum: tuple[tuple[float, ...], ...] = CURRICULUM, digits: int = 3, seed: int = 17) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with their own columns.

    The same mix as `curriculum_mix`, whose cases apply; here the documents travel with their places. The columns are
    those of `docs`, whatever their names; long texts are counted whole.
    """
    parts = materialise(prepared(docs, id_col, text_col, source_col, digits, seed).groupBy("missing", "source", "bucket").agg(F.sum("size").alias("part_size")), "mix-parts")
    rows = prepared(docs, id_col, text_col, source_col, digits, seed, F.struct(*[own(docs, c).alias(c) for c in docs.columns]).alias("row"))
    copies = placed(rows, parts, curriculum).select("row", "doc_id", F.explode("positions").alias("position"))
    return copies.orderBy("position", "doc_id").select("row.*")
