"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target: its share, by weight, of a multiple of all sizes, but no more than ``most`` times its own size;
what it can't take is shared again among the others. Target over size is how many copies a document of the source should
have on average. The whole part is given to all; the fraction is a probability that pivotal rounding turns into 0 or 1: two
documents meet, words move from one to the other in a random direction that keeps both expectations, until one
of them has no fraction left. So the words taken from a source stay what they were, up to its very last document.

Documents meet in leaves of some ``FAN`` documents; the one that a leaf leaves over goes up a level, where ``FAN`` leaves
meet, and so on: a reduction tree with a fold over a short array in each node. Only DataFrame code, nothing is gathered
beyond a node, and draws are hashes, so that reruns agree.

Defined results: size is the number of words (null text: 0); sources go by code point, null is a source of its own and the
last; documents without words have the copies of the whole part. Rows alike in key, source and size are one
item with a number, rounded together: they are interchangeable, so which of them has a copy more isn't defined, only how
many. A null key is a key. Texts are only counted, whatever their length; further columns aren't looked at; an empty table
gives an empty table. The order in a leaf is by size, then by hash and key, so ties of one leave no choice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ratewatch.llm.common import WORD_PATTERN, cut

#: Documents of a leaf on average, and nodes that meet in one node of the next level.
FAN = 64
#: Parts of each source when documents look up its target: a source may hold any share of the rows.
SALTS = 64
SEED = 20
_TINY = 1e-12
_WHITE = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """The number of words; each is replaced by one letter first, so that no list of words is made."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD_PATTERN + "+", "x"), _WHITE, "")), F.lit(0)).cast("long")


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``source, key, size, part, n``: how many rows of a partition are alike in source, key and size."""
    rows = docs.select(docs[source].alias("source"), docs[key].alias("key"), words_of(docs[text]).alias("size"), F.spark_partition_id().alias("part"))
    return rows.groupBy("source", "key", "size", "part").agg(F.count("*").alias("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """With ``place``: from 0 in the order of code points, null last. Ranges are numbered on their own, then moved."""
    ranged = cut(sources.orderBy(F.asc_nulls_last("source")).select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "sources")
    before = ranged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("range")) - F.col("n"))  # one row a range
    place = F.row_number().over(W.partitionBy("range").orderBy("at")) - 1 + F.col("before")
    return ranged.join(before.select("range", "before"), "range").withColumn("place", place).drop("range", "at", "before")


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, rows, target`` of all sources in ``rows (source, size, n)``.

    Weights repeat along the order of the sources. Each round knows the level up to which weights are served from
    two sums; those above their limit stop there and the level rises, until no further one stops.
    """
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    each = cut(numbered(sums).withColumn("weight", weight), "weights")
    limit = most * F.col("source_size")
    total = share * (each.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * level > limit
        now = each.agg(F.count_if(full).alias("n"), F.sum(F.when(full, limit)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if now.n == stopped or not now.open:
            break
        stopped, level = now.n, (total - (now.given or 0.0)) / now.open
    return each.select("source", "source_size", "rows", F.least(F.col("weight") * level, limit).alias("target"))


def _chance(*columns: Column) -> Column:
    """A number from 0 to 1 that hangs on these values alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *columns), F.lit(1 << 52)) / float(1 << 52)


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _meet(h: Column, x: Column) -> Column:
    """The two items after words have moved between them: one of them, at least, is at 0 or 1."""
    moves = F.struct(
        F.least((1 - h["q"]) * h["size"], x["q"] * x["size"]).alias("up"),
        F.least(h["q"] * h["size"], (1 - x["q"]) * x["size"]).alias("down"),
        _chance(h["key"], h["size"], x["key"], x["size"]).alias("draw"),
    )

    def rise(item: Column, words: Column) -> Column:
        return item.withField("q", F.when(words >= (1 - item["q"]) * item["size"], 1.0).otherwise(item["q"] + words / item["size"]))

    def fall(item: Column, words: Column) -> Column:
        return item.withField("q", F.when(words >= item["q"] * item["size"], 0.0).otherwise(item["q"] - words / item["size"]))

    return _bind(moves, lambda m: F.when(m["draw"] * (m["up"] + m["down"]) < m["down"], F.array(rise(h, m["up"]), fall(x, m["up"]))).otherwise(F.array(fall(h, m["down"]), rise(x, m["down"]))))


def _settled(item: Column) -> Column:
    return (item["q"] <= _TINY) | (item["q"] >= 1 - _TINY) | (item["size"] == 0)


def _fold(items: Column, kind: str) -> Column:
    """``held`` (the item that still has a fraction, or null) and ``decided`` of an array of items."""

    def step(state: Column, x: Column) -> Column:
        pool = F.when(_settled(x) | state["held"].isNull(), F.array(x)).otherwise(_meet(state["held"], x))
        return _bind(pool, lambda p: F.struct(F.coalesce(F.get(F.filter(p, lambda i: ~_settled(i)), 0), F.when(_settled(x), state["held"])).alias("held"), F.concat(state["decided"], F.filter(p, _settled)).alias("decided")))

    start = F.struct(F.lit(None).cast(kind).alias("held"), F.array().cast(f"array<{kind}>").alias("decided"))
    return F.aggregate(items, start, step)


def _looked_up(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with what ``sources`` has of their source; each source is there ``SALTS`` times, so none is one task's."""
    salted = sources.withColumnRenamed("source", "__source").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    with_salt = rows.withColumn("__row_salt", F.pmod(F.xxhash64("key", "size", "part"), F.lit(SALTS)).cast("int"))
    same = with_salt["source"].eqNullSafe(salted["__source"]) & (with_salt["__row_salt"] == salted["__salt"])
    return with_salt.join(salted, same).drop("__source", "__salt", "__row_salt")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``key, source, size, source_size, target, copies`` of every row: how often the mix takes it."""
    if share < 0 or most <= 0 or not weights or min(weights) <= 0:
        raise ValueError("weights and most have to be above 0, share not below")
    kind = docs.schema[key].dataType.simpleString()
    rows = cut(records(docs, key, text, source), "mix-records")
    sources = cut(targets(rows, weights, share, most).withColumn("leaves", F.ceil(F.col("rows") / FAN).cast("long")), "targets")
    ratio = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(most)))
    about = F.struct("source", "source_size", "target", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("fraction"))
    leaf = F.pmod(F.xxhash64(F.lit(SEED), "key", "size"), F.col("leaves"))
    dealt = _looked_up(rows, sources).select(about.alias("about"), leaf.alias("leaf"), "source", "key", "size", "n").repartition("source", "leaf")
    alike = dealt.groupBy("source", "leaf", "key", "size").agg(F.sum("n").alias("n"), F.first("about").alias("about"))
    mass = F.col("n") * F.col("about.fraction")
    item = F.struct((-F.col("size")).alias("less"), F.xxhash64("key").alias("order"), "key", "size", "n", F.floor(mass).alias("whole"), (mass - F.floor(mass)).alias("q"))
    items = alike.select("source", "leaf", "about", item.alias("item"))
    kind = f"struct<less:bigint,order:bigint,key:{kind},size:bigint,n:bigint,whole:bigint,q:double>"

    levels, leaves = [], sources.agg(F.max("leaves")).first()[0] or 0
    while True:
        nodes = items.groupBy("source", "leaf").agg(F.first("about").alias("about"), F.array_sort(F.collect_list("item")).alias("items"))
        folded = nodes.select("source", "leaf", "about", _fold(F.col("items"), kind).alias("x")).select("source", "leaf", "about", "x.held", "x.decided")
        levels.append(cut(folded, "mix-level"))
        left = levels[-1].where("held is not null")
        if leaves <= 1:
            break
        leaves = -(-leaves // FAN)
        items = left.select("source", F.floor(F.col("leaf") / FAN).alias("leaf"), "about", F.col("held").alias("item"))
    last = left.select("about", F.col("held").withField("q", (_chance(F.col("held.key"), F.col("held.size")) < F.col("held.q")).cast("double")).alias("i"))
    decided = reduce(DataFrame.unionByName, [level.select("about", F.explode("decided").alias("i")) for level in levels]).unionByName(last)
    up = F.when(F.col("i.size") > 0, (F.col("i.q") > 0.5).cast("long")).otherwise(0)
    found = decided.select("about.source", "i.key", "i.size", "about.source_size", "about.target", "about.base", "i.n", (F.col("i.whole") + up).alias("more"))
    names = ["key", "source", "size", "source_size", "target", "copies"]
    single = found.where("n = 1").withColumn("copies", F.col("base") + F.col("more")).select(*names)
    return single.unionByName(_dealt(found.where("n > 1"), rows).select(*names)).withColumnRenamed("key", key)


def _dealt(many: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of items that stand for several: the first ``more`` of them, along the partitions, have a copy more."""
    theirs = rows.select(F.col("source").alias("s"), F.col("key").alias("k"), F.col("size").alias("z"), "part", F.col("n").alias("c"))
    each = theirs.join(many, F.col("s").eqNullSafe(F.col("source")) & F.col("k").eqNullSafe(F.col("key")) & (F.col("z") == F.col("size")))
    before = F.sum("c").over(W.partitionBy("source", "key", "size").orderBy("part")) - F.col("c")
    yes = F.greatest(F.lit(0), F.least("c", F.col("more") - before))
    split = each.withColumn("yes", yes).withColumn("x", F.explode(F.array(F.struct((F.col("base") + 1).alias("copies"), F.col("yes").alias("times")), F.struct(F.col("base").alias("copies"), (F.col("c") - F.col("yes")).alias("times")))))
    return split.where("x.times > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("x.times")))).withColumn("copies", F.col("x.copies"))
