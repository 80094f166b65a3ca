"""Mixing sources to target weights, in DataFrame operations only.

Sizes are words. Every source is given a share of the total size by its weight; a target
never passes ``cap`` times its source's size, and the excess is reshared by weight. That
water filling has a closed form: order the sources by ``cap * size / weight``; the capped ones
are a prefix of that order, and the rest get ``weight * level`` with one common level.

A document of a source with rate r = target / size is taken floor(r) times and once more with
probability r - floor(r), by a hash of its id, text and the seed. The draws of a source aren't
independent of each other, which would miss its target by the size of its largest texts: its documents fall
in classes of about the same size, and a class of n whose probability is p gives n * p of them, rounded up or
down by a hash, those of the least hashes. The words that this rounding takes too many or too few are
spread over all smaller texts of the source, whose probability falls or rises accordingly; its mean over the hashes
stays the same, as both ways are shortened alike where one would leave [0, 1]. So each document has the
probability r - floor(r), and small texts make up for large ones.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of its
own, last in order; a source of size 0 has target 0 and is not taken; an empty table gives an empty result;
repeated rows (id and text) have one hash, and where only some of them are to be drawn, the first ones by their other columns are. Other
columns pass through untouched, but for those of the result's names, which are replaced (names that begin with ``__mix`` are used inside).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, row_key, small, table

#: Internal columns; chosen not to clash with those of a caller.
_SRC, _SIZE = "__mix_source", "__mix_size"


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """From (source, size per document) to (source, source_size, weight, target): one row per source.

    The windows over all sources take one task, which holds for the millions of sources that fit one.
    """
    totals = sizes.groupBy(_SRC).agg(F.sum(_SIZE).alias("source_size"))
    order = Window.orderBy(F.col(_SRC).asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    ratio = F.lit(cap) * F.col("source_size") / F.col("weight")
    by_ratio = Window.orderBy(ratio.asc(), F.col(_SRC).asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = (
        weighed.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", level)
        .withColumn("ratio", ratio)
    )
    # the level that holds is the one of the first source in ratio order that stays under its cap
    held = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    return (
        leveled.withColumn("held", held)
        .withColumn(
            "target",
            F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
                F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("held.level"), F.col("ratio")) * F.col("weight"))
            ),
        )
        .select(_SRC, "source_size", "weight", "target")
    )


#: Size classes for each doubling of the size, and parts of a class's hashes that are counted apart.
FINE, BINS = 8, 1024
RESULT = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _part():
    """The part of the class's hashes (52 bits) that a hash lies in."""
    return F.shiftrightunsigned("__mix_hash", 53 - BINS.bit_length())


def _same(source: str, of_class: str):
    """The same class; null-safe, or a filter for nulls would count all words once more."""
    return F.col(_SRC).eqNullSafe(F.col(source)) & F.col("__mix_class").eqNullSafe(F.col(of_class))


def _next(state, c):
    """One class more, from the largest down: how many of it are drawn, and the probability that is left to smaller texts."""
    rest, mean = state.rest - c.words, c.words / c.n
    low = F.floor(c.n * state.p)
    over = c.n * state.p - low
    up = c.u < over
    # words taken beyond the expected ones, as far as the smaller texts can make up for either outcome
    share = F.least(F.lit(1.0), F.try_divide(state.p * rest, (1 - over) * mean), F.try_divide((1 - state.p) * rest, over * mean))
    error = share * mean * F.when(up, 1 - over).otherwise(-over)
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), state.p - F.coalesce(F.try_divide(error, rest), F.lit(0.0))))
    drawn = F.struct(c["class"].alias("class"), (low + up.cast("long")).alias("m"))
    return F.struct(p.alias("p"), rest.alias("rest"), F.concat(state.drawn, F.array(drawn)).alias("drawn"))


def class_draws(parts: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """(c_src, c_class, m): documents drawn of each class. parts: (source, class, n, words), rates: (__mix_key, __mix_rate).

    A source's classes are one array, FINE for each doubling of a text's size: some hundreds.
    """
    classes = parts.groupBy(_SRC, "__mix_class").agg(F.sum("n").alias("n"), F.sum("words").cast("double").alias("words"))
    u = F.shiftrightunsigned(F.xxhash64(F.col(_SRC), F.col("__mix_class"), F.lit(seed), F.lit("class")), 12) / F.lit(float(1 << 52))
    of = F.struct(F.col("__mix_class").alias("class"), "n", "words", u.alias("u"))
    listed = classes.groupBy(_SRC).agg(F.sort_array(F.collect_list(of), asc=False).alias("of"), F.sum("words").alias("rest"))
    listed = listed.join(rates.select("__mix_key", "__mix_rate"), F.col(_SRC).eqNullSafe(F.col("__mix_key")))
    start = F.struct(
        (F.col("__mix_rate") - F.floor("__mix_rate")).alias("p"), F.col("rest"), F.array().cast("array<struct<class:int,m:bigint>>").alias("drawn")
    )
    drawn = F.aggregate("of", start, _next, lambda state: state.drawn)
    return listed.select(F.col(_SRC).alias("c_src"), F.inline(drawn).alias("c_class", "m")).where("m > 0")


def draw_limits(light: DataFrame, parts: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """(c_src, c_class, limit): all below ``limit.hash`` are drawn, and ``limit.some`` of the ``limit.n`` that have it.

    The hash of the right rank is found by counting: of parts of the hashes first, then within one part, so no
    class is ever sorted as a whole. light: (source, class, hash).
    """
    so_far = F.sum("n").over(Window.partitionBy(_SRC, "__mix_class").orderBy("part"))
    at = parts.withColumn("upto", so_far).join(class_draws(parts, rates, seed), _same("c_src", "c_class"))
    at = at.where((F.col("upto") - F.col("n") < F.col("m")) & (F.col("m") <= F.col("upto")))
    at = materialize(at.select("c_src", "c_class", F.col("part").alias("c_part"), (F.col("m") - F.col("upto") + F.col("n")).alias("m")), "mix-places")
    within = light.withColumn("__mix_part", _part()).join(small(at), _same("c_src", "c_class") & (F.col("__mix_part") == F.col("c_part")))
    hashes = within.groupBy("c_src", "c_class", "__mix_hash").agg(F.count("*").alias("n"), F.first("m").alias("m"))
    reached = hashes.withColumn("upto", F.sum("n").over(Window.partitionBy("c_src", "c_class").orderBy("__mix_hash"))).where("upto >= m")
    limit = F.struct(F.col("__mix_hash").alias("hash"), (F.col("m") - F.col("upto") + F.col("n")).alias("some"), "n")
    return reached.groupBy("c_src", "c_class").agg(F.min(limit).alias("__mix_limit"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, seed: int = 17
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies."""
    # 52 bits of the hash
    draw = F.shiftrightunsigned(F.xxhash64(row_key(id_col, text_col), F.lit(seed)), 12)
    own = docs.drop(*RESULT)
    sized = (
        own.withColumn(_SIZE, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn(_SRC, F.col(source_col))
        .withColumn("__mix_class", F.floor(F.log2(F.col(_SIZE) + F.lit(1.0)) * FINE).cast("int"))
        .withColumn("__mix_hash", draw)
    )
    light = materialize(sized.select(_SRC, _SIZE, "__mix_class", "__mix_hash"), "mix-sizes")
    parts = materialize(light.groupBy(_SRC, "__mix_class", _part().alias("part")).agg(F.count("*").alias("n"), F.sum(_SIZE).alias("words")), "mix-parts")
    t = source_targets(parts.select(_SRC, F.col("words").alias(_SIZE)), cap)
    t = t.select(F.col(_SRC).alias("__mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.lit(cap), F.col("mix_target") / F.col("mix_source_size"))).otherwise(F.lit(0.0))
    t = t.withColumn("__mix_rate", rate)
    # sources, and their classes, as few as counted there go to all tasks, so that no text moves
    both = materialize(
        parts.select(_SRC, "__mix_class").distinct().join(t, F.col(_SRC).eqNullSafe(F.col("__mix_key")))
        .join(draw_limits(light, parts, t, seed), _same("c_src", "c_class"), "left")
        .select("__mix_key", F.col("__mix_class").alias("__mix_of"), "mix_source_size", "mix_target", "__mix_rate", "__mix_limit"),
        "mix-limits",
    )
    joined = sized.join(small(both), _same("__mix_key", "__mix_of"))
    limit = F.col("__mix_limit")
    split = F.coalesce((F.col("__mix_hash") == limit["hash"]) & (limit["some"] < limit["n"]), F.lit(False))
    more = F.when(F.col("__mix_hash") <= limit["hash"], 1).otherwise(0)
    if both.where("__mix_limit.some < __mix_limit.n").limit(1).count():
        # equal rows of which some are drawn: only these are numbered
        plain = [c for c, kind in own.dtypes if "map<" not in kind and "variant" not in kind]
        place = F.row_number().over(Window.partitionBy(_SRC, "__mix_class", "__mix_hash").orderBy(F.xxhash64(*plain)))
        numbered = joined.where(split).withColumn("__mix_more", F.when(place <= limit["some"], 1).otherwise(0))
        joined = joined.where(~split).withColumn("__mix_more", more).unionByName(numbered)
    else:
        joined = joined.withColumn("__mix_more", more)
    return joined.withColumn("mix_copies", (F.floor("__mix_rate") + F.col("__mix_more")).cast("int")).select(*own.columns, F.col(_SIZE).alias("mix_size"), *RESULT[1:])


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Every document as often as the mix takes it, without the mix columns."""
    return (
        mixed.where("mix_copies > 0")
        .withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
        .drop("__mix_copy", *RESULT)
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
        F.col("mix_copies").alias("copies"),
    )


QUERIES = {"op6_mix_sources": op6_mix_sources}
ORACLE: dict[str, str] = {}
