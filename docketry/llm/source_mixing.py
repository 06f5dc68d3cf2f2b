"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every source gets a target number of words. A document of a source with target t and size z is wanted
t / z times; the whole part of that number is certain, the fraction is a probability. The pivotal method
takes two fractions at a time and moves mass between them, in words, by a random step after which one of
them is 0 or 1 and the words of the two together are what they were. Documents are dealt at random into
small buckets of their source; each bucket is folded to decided documents and one undecided residual, and
the residuals go through the same step, level by level, until one per source is left. That last one is
rounded to the nearer side, so a source misses its target by half a document at most.

All random draws are hashes of document ids, so reruns agree. Equal rows are one unit with a multiplicity
until the end. A hot source only has more buckets; no bucket holds more than a small random number of units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docketry.llm.common import CHECK, CONTENT, WORD, content_keys, documents, in_order, running_start
from docketry.session import materialise

#: Mean number of units folded by one bucket.
BUCKET = 64
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size) of every row; size is the number of words, 0 for null and empty texts."""
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return documents(docs, "source").select("doc_id", "source", words.alias("size"), *more)


def weighted(sources: DataFrame) -> DataFrame:
    """Add ``weight``: 1, 2, 3 and again, over the sources by code point, null last.

    The sources' names are ranged and written, one row each, so that no task numbers all of them.
    """
    ranges = in_order(sources.withColumn("_null", F.col("source").isNull()), "_null", "source", name="sources")
    within = Window.partitionBy("_range").orderBy("_null", "source")
    place = F.row_number().over(within) - 1 + F.col("_start")
    choices = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    return (
        ranges.join(F.broadcast(running_start(ranges, F.lit(1))), "_range")  # one row per partition
        .withColumn("weight", F.element_at(choices, (place % len(WEIGHTS) + 1).cast("int")))
        .drop("_range", "_start", "_null")
    )


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above ``MOST_COPIES`` times its source.

    What the limit takes from a source is shared among the others by weight, until none is above. With the
    share of a weight of one as the unknown, each round fixes the sources above their limit; the unknown only
    grows, so the rounds end, after a few. Each round is one aggregate over one row per source.
    """
    grouped = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialise(weighted(grouped).withColumn("_limit", F.col("source_size") * float(MOST_COPIES)), "targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    unit, capped = 0.0, -1
    while True:
        over = F.col("_limit") < F.col("weight") * F.lit(unit)
        fixed, words, open_weight = sources.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, F.col("_limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if fixed == capped or not open_weight:
            break
        capped, unit = fixed, (total - words) / open_weight
    share = F.least(F.col("weight") * F.lit(unit), F.col("_limit"))
    return sources.select("source", "source_size", share.alias("target"))


def chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def unit_fields(key, size, p) -> Column:
    return F.struct(key.alias("key"), size.alias("size"), p.alias("p"))


def pivotal_step(state: Column, unit: Column) -> Column:
    """Move words between the carried unit and the next until one of them is decided; carry the other."""
    one, two = state["carry"], unit
    rise = F.least((1.0 - one["p"]) * one["size"], two["p"] * two["size"])  # words one can gain
    fall = F.least(one["p"] * one["size"], (1.0 - two["p"]) * two["size"])  # words one can lose
    up = chance(one["key"], two["key"], F.lit("step")) * (rise + fall) < fall
    one_up = F.when((1.0 - one["p"]) * one["size"] <= two["p"] * two["size"], 1.0).otherwise(
        one["p"] + rise / one["size"]
    )
    two_up = F.when(two["p"] * two["size"] <= (1.0 - one["p"]) * one["size"], 0.0).otherwise(
        two["p"] - rise / two["size"]
    )
    one_down = F.when(one["p"] * one["size"] <= (1.0 - two["p"]) * two["size"], 0.0).otherwise(
        one["p"] - fall / one["size"]
    )
    two_down = F.when((1.0 - two["p"]) * two["size"] <= one["p"] * one["size"], 1.0).otherwise(
        two["p"] + fall / two["size"]
    )
    moved = F.struct(
        unit_fields(one["key"], one["size"], F.when(up, one_up).otherwise(one_down)).alias("one"),
        unit_fields(two["key"], two["size"], F.when(up, two_up).otherwise(two_down)).alias("two"),
    )
    # the pair as a one-element array, so that its expressions are worked out once
    return F.element_at(
        F.transform(
            F.array(moved),
            lambda m: F.when(
                (m["one"]["p"] == 0.0) | (m["one"]["p"] == 1.0),
                F.struct(m["two"].alias("carry"), F.array_append(state["decided"], m["one"]).alias("decided")),
            ).otherwise(F.struct(m["one"].alias("carry"), F.array_append(state["decided"], m["two"]).alias("decided"))),
        ),
        1,
    )


def fold(buckets: DataFrame) -> DataFrame:
    """(source, bucket, unit) -> (source, bucket, carry, decided): each bucket's units folded one by one."""
    ordered = F.sort_array(F.collect_list(F.struct(chance(F.col("unit.key"), F.lit("order")).alias("at"), "unit")))
    units = buckets.groupBy("source", "bucket").agg(F.transform(ordered, lambda x: x["unit"]).alias("units"))
    first = F.col("units")[0]
    start = F.struct(first.alias("carry"), F.slice("units", 1, 0).alias("decided"))
    folded = F.aggregate(F.slice("units", F.lit(2), F.size("units")), start, pivotal_step)
    return units.select("source", "bucket", folded.alias("folded")).select("source", "bucket", "folded.*")


def bucket_of(key: Column, number: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level)), number)


def round_fractions(units: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(source, key, size, p) with 0 < p < 1 and size > 0 -> (source, key, taken) with taken 0 or 1.

    A source's sum of p * size is kept but for half of one unit's size; a unit is taken with probability p.
    """
    units = units.withColumn("size", F.col("size").cast("double"))
    numbers = materialise(units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("buckets")), "buckets")
    todo = units.select("source", unit_fields(F.col("key"), F.col("size"), F.col("p")).alias("unit"))
    parts, level = [], 0
    while most := numbers.agg(F.max("buckets")).first()[0]:
        per_source = numbers.withColumnRenamed("source", "_source")
        dealt = todo.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source", "unit", bucket_of(F.col("unit.key"), F.col("buckets"), level).alias("bucket")
        )
        folded = materialise(fold(dealt), f"level{level}")
        parts.append(folded.select("source", F.explode("decided").alias("unit")))
        todo = folded.select("source", F.col("carry").alias("unit"))
        if most == 1:
            parts.append(todo)
            break
        numbers = materialise(numbers.select("source", F.ceil(F.col("buckets") / bucket).alias("buckets")), "buckets")
        level += 1
    schema = "source string, unit struct<key: string, size: double, p: double>"
    decided = units.sparkSession.createDataFrame([], schema)
    for part in parts:
        decided = decided.unionByName(part)
    return decided.select("source", F.col("unit.key").alias("key"), F.round("unit.p").cast("int").alias("taken"))


def unit_copies(sized: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, source, size, ...) -> one row per distinct row, with ``rows``, ``copies``, source_size and target.

    ``rows`` is how often it occurs and ``copies`` how often the mix takes it, all its rows together.
    """
    goals = materialise(targets(sized), "goals").withColumnRenamed("source", "_source")
    units = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("rows"))
    wanted = F.when(F.col("size") > 0, F.col("rows") * F.col("target") / F.col("source_size")).otherwise(0.0)
    # no two rows have the same key: a null is "-", any other value has its length before it
    texts = [F.col(c).cast("string") for c in sized.columns if c != "source"]
    own = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    units = (
        units.join(goals, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_wanted", wanted)
        .withColumn("_whole", F.floor("_wanted"))
        .withColumn("_p", F.col("_wanted") - F.col("_whole"))
        .withColumn("_key", F.concat(*own))
    )
    units = materialise(units, "units")
    open_units = units.filter("_p > 0").select("source", F.col("_key").alias("key"), "size", F.col("_p").alias("p"))
    taken = round_fractions(open_units, bucket).select(
        F.col("source").alias("_source"), F.col("key").alias("_taken_key"), F.col("taken").alias("_taken")
    )
    same = (F.col("_key") == F.col("_taken_key")) & F.col("source").eqNullSafe(F.col("_source"))
    copies = (F.col("_whole") + F.coalesce("_taken", F.lit(0))).cast("long")
    return units.join(taken, same, "left").select(
        *sized.columns, "source_size", "target", "rows", copies.alias("copies")
    )


def mix(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for every row of ``docs``.

    ``copies`` (0 to 3) is how often the mix takes the document. Documents without words are taken 0 times.
    A null doc_id or source is a value like any other, other columns are not read, equal rows get copies that
    differ by one at most, and an empty table gives an empty result.
    """
    units = unit_copies(materialise(sizes(docs), "sizes"), bucket)
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_row")  # the rows that were equal
    more = (F.col("_row") <= F.col("copies") % F.col("rows")).cast("long")
    return (
        units.select("doc_id", "size", "source", "source_size", "target", "rows", "copies", row)
        .withColumn("copies", F.floor(F.col("copies") / F.col("rows")) + more)
        .drop("rows", "_row")
    )


def mixed_documents(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the same columns.

    Rows that agree in doc_id, source and text count as equal, whatever their other columns hold.
    """
    keys = content_keys(F.col("doc_id"), F.col("source"), F.coalesce("text", F.lit("")))
    copies = unit_copies(materialise(sizes(docs, *keys), "sizes"), bucket).filter("copies > 0")
    keyed = docs.select("*", *keys).dropDuplicates([CONTENT, CHECK])
    taken = keyed.join(copies.select(CONTENT, CHECK, F.col("copies").alias("__docketry_copies")), [CONTENT, CHECK])
    number = F.sequence(F.lit(1).cast("long"), F.col("__docketry_copies"))
    return taken.withColumn("__docketry_copy", F.explode(number)).select(*docs.columns)
