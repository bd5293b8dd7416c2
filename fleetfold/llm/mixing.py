"""Mixing sources to target weights by Pareto order sampling.

A source that is to give T words takes document i, of s_i words, m_i = min(most, level * s_i) times on average:
in proportion to its size, with the level at which the expected words are T. floor(m_i) copies are certain;
the rest p_i = m_i - floor(m_i) is the document's own inclusion probability. Documents draw a random number u
and are ranked by the odds ratio (u / (1 - u)) / (p_i / (1 - p_i)); the sample is the top of the ranking. Its
size is fixed in words, which is what targets count: documents are taken in order as long as that brings the
source nearer to its target, so it misses it by half of the document at the end at the most. u is a digest of
id and text, so reruns agree.

No source is sorted: ranks are counted in bins, a running sum over at most ``BINS`` rows per source finds the bin in
which it fills up, and only that bin's documents are put in order. The level comes from the numbers of documents of
each size. What is joined back to the documents is one row per source.

A text without words, null or not, has size 0 and is never taken; null is a source like any
other, the last in order. Rows that repeat id and text rank together and are taken or left together.
Empty sources and an empty table give no words. Extra columns pass through; names of results replace
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetfold.llm.common import stored, word_count

BINS = 1 << 16
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST = 2
# One row per source may be copied to every executor up to this many sources.
BROADCAST_SOURCES = 1_000_000


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Per source (``source``, ``source_size``): ``target`` words.

    A source is capped when an even share of what is left would exceed ``most`` times its size. In
    order of size per weight the capped ones stand first, so the level is found by one running sum.
    The windows hold one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    weighed = sizes.withColumn("_w", F.get(weights, (F.row_number().over(order) - 1) % len(cycle)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    summed = weighed.withColumn("_cap", F.col("source_size").cast("double") * most).withColumns(
        {
            "_total": F.sum("source_size").over(everything) * share,
            "_weights": F.sum("_w").over(everything),
            "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_used": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    level = summed.withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_used")))
    # The first source under its cap has the final level; counting it as capped lowers those that follow.
    final = F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))).over(everything)
    target = F.least(F.coalesce(final * F.col("_w"), F.col("_cap")), F.col("_cap"))
    return level.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, text: Column, seed: int = 1) -> Column:
    """Digest of a document: its rank among equals, and the source of its random number."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of a digest."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def expected(size: Column, level: Column, most: int = MOST) -> Column:
    """Copies of a document on average; a null level takes every document ``most`` times."""
    wanted = F.coalesce(F.least(level * size, F.lit(float(most))), F.lit(float(most)))
    return F.when(size > 0, wanted).otherwise(0.0)


def _odds(copies_: Column, digest: Column) -> Column:
    """Null where nothing but whole copies is taken."""
    p = copies_ - F.floor(copies_)
    u = uniform(digest)
    return F.when(p > 0, (u / (1.0 - u)) / (p / (1.0 - p)))


def _bin(rank: Column) -> Column:
    return F.floor(rank / (1.0 + rank) * BINS).cast("int")


def levels(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Per source: ``_level``, and ``_wanted``, the words to be sampled beside whole copies.

    ``sizes``: source, target, size, n (documents of that size). From the largest size down, a size is capped
    when the level of what is left would exceed ``most``; one running sum over the sizes of a source finds it.
    """
    words, squares = F.col("n") * F.col("size"), F.col("n").cast("decimal(38,0)") * F.col("size") * F.col("size")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(words).over(larger), F.lit(0)).cast("double")
    rest = F.sum(squares.cast("decimal(38,0)")).over(smaller).cast("double")
    rows = sizes.filter("size > 0").withColumn("_level", (F.col("target") - most * capped) / rest)
    fits = F.max(F.when(F.col("_level") * F.col("size") <= most, F.col("_level"))).over(Window.partitionBy("source"))
    rows = rows.withColumn("_level", fits)
    whole = F.floor(expected(F.col("size"), F.col("_level"), most))
    return rows.groupBy("source").agg(F.first("_level").alias("_level"), (F.first("target") - F.sum(words * whole)).alias("_wanted"))


def plan(narrow: DataFrame, most: int = MOST, **shares) -> DataFrame:
    """Per source: source_size, target, level, and the end of its ranking (bin, rank, digest).

    ``narrow`` has source, size and digest; it is read three times, so it should be a stored table.
    """
    counted = stored(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    goal = stored(targets(counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), most=most, **shares), "targets")
    level = levels(by_source(counted, goal.select("source", "target")), most)
    goal = stored(by_source(goal, level, "left"), "levels")
    copies_ = expected(F.col("size"), F.col("_level"), most)
    ranked = by_source(narrow, goal).withColumn("_rank", _odds(copies_, F.col("digest"))).filter(F.col("_rank").isNotNull() & (F.col("_wanted") > 0))
    ranked = ranked.withColumn("_bin", _bin(F.col("_rank")))
    bins = ranked.groupBy("source", "_bin").agg(F.sum("size").alias("_words"), F.first("_wanted").alias("_wanted"))
    upto = Window.partitionBy("source").orderBy("_bin")
    filled = bins.withColumn("_before", F.sum("_words").over(upto) - F.col("_words"))
    # The last bin that starts below the wanted words is the one in which the source fills up.
    last = filled.filter(F.col("_before") < F.col("_wanted")).groupBy("source").agg(F.max(F.struct("_bin", "_before")).alias("_last"))
    last = stored(last.select("source", F.col("_last._bin").alias("_end"), F.col("_last._before").alias("_before")), "bins")
    inside = by_source(ranked, last).filter(F.col("_bin") == F.col("_end"))
    in_order = Window.partitionBy("source").orderBy("_rank", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_before") + F.sum("size").over(in_order) - F.col("size") / 2
    taken = inside.withColumn("_middle", middle).filter(F.col("_middle") <= F.col("_wanted"))
    cut = taken.groupBy("source").agg(F.max(F.struct("_rank", "digest")).alias("_cut"))
    return by_source(by_source(goal, last.drop("_before"), "left"), cut, "left")


def by_source(rows: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per source, null being a source; copied to the executors if there are few enough."""
    right = per_source.withColumnRenamed("source", "_source")
    if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        right = F.broadcast(right)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def copies(rows: DataFrame, planned: DataFrame, most: int = MOST) -> DataFrame:
    """Add source_size, target and copies to rows with source, size and digest."""
    joined = by_source(rows, planned)
    wanted = expected(F.col("size"), F.col("_level"), most)
    rank = _odds(wanted, F.col("digest"))
    early = (_bin(rank) < F.col("_end")) | (
        (_bin(rank) == F.col("_end")) & (F.struct(rank.alias("_rank"), F.col("digest")) <= F.col("_cut"))
    )
    extra = F.when((F.col("_wanted") > 0) & F.coalesce(early, F.lit(False)), 1).otherwise(0)
    out = joined.withColumn("copies", F.floor(wanted) + extra)
    return out.drop("_level", "_wanted", "_end", "_cut")


def sized(docs: DataFrame, seed: int = 1) -> DataFrame:
    return docs.withColumns({"size": word_count(F.col("text")), "digest": draw(F.col("doc_id"), F.col("text"), seed)})


def mix(docs: DataFrame, seed: int = 1, most: int = MOST, **shares) -> DataFrame:
    """One row per document (doc_id, source, size) with source_size, target, copies and taken."""
    narrow = stored(sized(docs, seed).select("doc_id", "source", "size", "digest"), "mix")
    return copies(narrow, plan(narrow, most, **shares), most).withColumn("taken", F.col("size") * F.col("copies")).drop("digest")


def mixed_rows(docs: DataFrame, seed: int = 1, most: int = MOST, **shares) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it had."""
    # Helper columns live beside the document, so names of the input cannot clash with them.
    whole = docs.select(F.struct("*").alias("_doc"), "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("digest"))
    narrow = stored(whole.drop("_doc"), "mix")
    taken = copies(whole, plan(narrow, most, **shares), most).filter(F.col("copies") > 0)
    repeated = taken.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return repeated.select("_doc.*")
