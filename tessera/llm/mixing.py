"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in DataFrame functions.

Every document gets the key -ln(u) / w with u from the MD5 of its id and text and w its quality weight,
so in ascending key order a source's documents form a weighted sample without replacement. Words are
prefix-summed in that order to the source's budget: complete epochs first, then the documents whose
prefix lies within the remaining words (the last one in part).

A source may hold a third of all rows, so no window ever covers a whole source: keys are cut into bins,
the words of each (source, bin) are summed first, the bins' prefix sums come from that small table, and
row-level windows run within one bin. Keys of one weight are exponential, so on a logarithmic scale no
octave holds more than 26 % of them, whatever the weight: `bins` to an octave bound a bin's share of a
source, also where all its weights are equal and low.

Defined cases: a null source is a source of its own, after all others; a null or empty text has size 0
and is taken 0 times; equal keys fall back on id and the rest of the MD5, rows equal in all of these are
interchangeable; repeated rows count each; an empty table gives an empty mix; a source without words
gets target 0; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WEIGHTS = (3.0, 1.0, 2.0)
EPOCHS = 2
TOTAL = 1.5
#: Bins of the sampling order within a source, to each doubling of the key.
BINS = 512
WORDS = r"[^\x20\x09-\x0D]+"


def size_in_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Weight in [0.1, 1] from the text alone: the share of characters that aren't symbols, floored."""
    symbols = F.length(text) - F.length(F.translate(text, "#$%&*@^~|<>{}[]=_+\\!", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(0.1))


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, total: float = TOTAL, epochs: float = EPOCHS) -> list[float]:
    """Words for each source, in the order given; no source above `epochs` times its size.

    What a capped source can't use goes to the others by weight, until none is above its cap.
    """
    share = [weights[k % len(weights)] for k in range(len(sizes))]
    left = total * sum(n for _, n in sizes)
    got: dict[int, float] = {}
    free = list(range(len(sizes)))
    while free:
        unit = left / sum(share[k] for k in free)
        full = [k for k in free if share[k] * unit > epochs * sizes[k][1]]
        if not full:
            got.update((k, share[k] * unit) for k in free)
            break
        for k in full:
            got[k] = float(epochs * sizes[k][1])
            left -= got[k]
        free = [k for k in free if k not in got]
    return [got[k] for k in range(len(sizes))]


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size and target from (source, source_size): the filling of `targets` as window sums.

    With sources in ascending order of cap / weight, a source stays below its cap exactly if the level
    left by those before it, (budget - their caps) / (all weights - theirs), is not above its own ratio;
    the first such level is the common one. The windows run over one row per source.
    """
    w = F.lit(None).cast("double")
    for k, value in enumerate(weights):
        w = F.when(F.col("pos") % len(weights) == k, F.lit(float(value))).otherwise(w)
    by_code_point = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("pos", F.row_number().over(by_code_point) - 1).withColumn("w", w).withColumn("cap", epochs * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "pos").rowsBetween(Window.unboundedPreceding, -1)
    level = (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    leveled = ranked.withColumn("level", level)
    common = F.max(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(common, F.lit(float("inf"))))
    return leveled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, epochs: int = EPOCHS, bins: int = BINS, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document (and source, weight)."""
    text = docs["text"].cast("string")
    digest = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text, F.lit(""))))
    number = lambda at, digits: F.conv(F.substring(digest, at, digits), 16, 10).cast("bigint")
    u = (number(1, 13).cast("double") + 0.5) / float(1 << 52)
    tie = number(14, 15)
    sized = docs.select(
        "doc_id",
        docs["source"].cast("string").alias("source"),
        size_in_words(text).alias("size"),
        (quality_weight(text) if weight is None else weight).cast("double").alias("weight"),
        tie.alias("tie"),
        u.alias("u"),
    )
    sized = materialize(
        sized.withColumn("key", -F.log("u") / F.col("weight"))
        .withColumn("bin", F.floor(F.log2(F.greatest(F.col("key"), F.lit(1e-18))) * bins).cast("int"))
        .withColumns({"known": F.col("source").isNotNull(), "name": F.coalesce("source", F.lit(""))})
        .drop("u")
    )
    binned = sized.groupBy("name", "known", "bin").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("name", "known").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.withColumn("bin_start", F.coalesce(F.sum("words").over(order), F.lit(0))).drop("words")
    per = binned.groupBy("name", "known").agg(F.sum("words").alias("source_size"))
    per = per.select(F.when(F.col("known"), F.col("name")).alias("source"), "source_size")
    aims = source_targets(per, weights, total, epochs)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNotNull().alias("known"), "source_size", "target")
    starts = starts.join(aims, ["name", "known"])
    within = Window.partitionBy("name", "known", "bin").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    left = F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("bigint")
    return (
        sized.join(starts, ["name", "known", "bin"])
        .withColumn("before", F.col("bin_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .withColumn("full", full)
        .withColumn("taken", F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before"))))
        .select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"), "weight")
    )
