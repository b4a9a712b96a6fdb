"""Which sets hold all members of which others: interfaces and the types that have all their methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import MOST_PARTS, broadcast_if_small, materialize

WIDE = 1_024  # methods of a package that have a bit each; beyond it, bits are shared and only exclude
WORD = 64
IDS = 64  # about as many ids of one set share a row
BUCKET = 1_024  # rows of types that are cut into blocks together
SLOTS = 32  # methods of an interface that are looked up without a lambda
PAIRS = 1 << 30  # pairs of a package that a task looks at, 64 at a time

#: The places of the bits of each byte.
_PLACES = "array(" + ", ".join(f"array({', '.join(str(p) for p in range(8) if v >> p & 1)})" if v else "cast(array() AS array<int>)" for v in range(256)) + ")"


def _words(rows: DataFrame, n: int, name: str) -> DataFrame:
    """(_in, id, name0, name1, ...): the bits of all methods of an id; open: one of them has none."""
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % WORD)
    word = F.floor(F.col("bit") / WORD)
    bits = (F.coalesce(F.bit_or(F.when(word == k, mask)), F.lit(0)).alias(f"{name}{k}") for k in range(n))
    return rows.groupBy("_in", "id").agg(*bits, F.max(F.col("bit").isNull()).alias("open"))


def _several(*members: DataFrame) -> DataFrame:
    """The ids that are in several packages."""
    rows = reduce(DataFrame.unionByName, (m.select("_in", "id") for m in members))
    return materialize(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("twice")), "twice")


def _sets(words: DataFrame, n: int) -> DataFrame:
    """(_in, w0, w1, ..., twice, ids): equal sets of a package are one row, or one for about IDS ids."""
    key = ["_in", *(f"w{k}" for k in range(n)), "twice"]
    often = materialize(words.groupBy(*key).count().where(F.col("count") > IDS), "equal-sets")
    share = F.when(F.col("count") > IDS, F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / IDS))).otherwise(0)
    return words.join(broadcast_if_small(often), key, "left").groupBy(*key, share.alias("share")).agg(F.collect_list("id").alias("ids"))


def _blocks(sets: DataFrame, n: int) -> DataFrame:
    """(_in, twice, masks, ids): 64 sets of a package to a row. A mask for each method says which of them have it."""
    sets = materialize(sets, "containment")
    buckets = sets.groupBy("_in", "twice").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    one = F.struct("ids", F.array(*(f"w{k}" for k in range(n))).alias("words"))
    rows = sets.join(broadcast_if_small(buckets), ["_in", "twice"]).groupBy("_in", "twice", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), "buckets").alias("bucket")).agg(F.collect_list(one).alias("all"))
    rows = rows.select("_in", "twice", "all", F.explode(F.sequence(F.lit(1), F.size("all"), F.lit(WORD))).alias("first")).select("_in", "twice", F.slice("all", F.col("first"), F.lit(WORD)).alias("part"))
    shift = lambda way, c, by: F.call_function(f"shift{way}", c, by)
    has = lambda words, bit: shift("right", F.get(words, F.floor(bit / WORD).cast("int")), bit).bitwiseAND(F.lit(1).cast("bigint"))  # noqa: E731  shifts count modulo 64
    mask = lambda bit: F.aggregate(F.reverse("part"), F.lit(0).cast("bigint"), lambda m, x: shift("left", m, F.lit(1)).bitwiseOR(has(x["words"], bit)))
    return rows.select("_in", "twice", F.transform(F.sequence(F.lit(0), F.lit(n * WORD - 1)), mask).alias("masks"), F.transform("part", lambda x: x["ids"]).alias("ids"))


def _bits(n: int) -> Column:
    """The numbers of the methods of a set, rarest first; the first again at the end, up to a multiple of four."""
    one = lambda k: F.filter(F.sequence(F.lit(k * WORD), F.lit(k * WORD + WORD - 1)), lambda b: F.call_function("shiftright", F.col(f"w{k}"), b).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    none = F.expr("cast(array() AS array<int>)")
    bits = F.concat(*(F.when(F.col(f"w{k}") == 0, none).otherwise(one(k)) for k in range(n)))
    return F.transform(F.array(bits), lambda b: F.concat(b, F.array_repeat(F.get(b, F.lit(0)), F.pmod(-F.size(b), F.lit(4)).cast("int"))))[0]


def _met(sets: DataFrame, blocks: DataFrame, most: int, on: list[str], also: Column) -> DataFrame:
    """(src, dst): in a block, 64 sets are compared at once, by the masks of the methods of an interface."""
    at = lambda k: F.get("masks", F.get("bits", F.lit(k)))
    four = lambda k: at(k).bitwiseAND(at(k + 1)).bitwiseAND(at(k + 2)).bitwiseAND(at(k + 3))
    every = F.lit(-1).cast("bigint")
    mask = four(0)
    for k in range(4, min(most, SLOTS), 4):
        mask = mask.bitwiseAND(F.when(F.size("bits") > k, four(k)).otherwise(every))
    if most > SLOTS:
        mask = mask.bitwiseAND(F.aggregate("bits", every, lambda m, b: m.bitwiseAND(F.get("masks", b))))
    # whole-stage code would hold all pairs of an interface at once; the lambda keeps this join out of it and is asked last
    some = F.exists(F.array(F.get("bits", F.lit(0))), lambda b: F.get("masks", b) != 0)
    rule = (four(0) != 0) & (mask != 0) & also & some
    left, right = sets.alias("i"), blocks.alias("t")
    pairs = left.join(right, reduce(lambda a, b: a & b, (F.col(f"i.{c}") == F.col(f"t.{c}") for c in on)) & rule).select("dsts", "ids", mask.alias("mask"))
    pairs = pairs.select("dsts", "ids", "mask", F.explode(F.expr("array(0, 1, 2, 3, 4, 5, 6, 7)")).alias("k"))
    pairs = pairs.select("dsts", "ids", "k", F.expr("cast(shiftrightunsigned(mask, 8 * k) & 255 AS int)").alias("byte")).where("byte <> 0")
    pairs = pairs.select("dsts", "ids", "k", F.explode(F.get(F.expr(_PLACES), F.col("byte"))).alias("p"))
    return pairs.select("dsts", F.explode(F.get("ids", 8 * F.col("k") + F.col("p"))).alias("src")).select("src", F.explode("dsts").alias("dst"))


def _decided(wants: DataFrame, has: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(src, dst) of packages in which a bit is a method, from words by id: pairs that come once, and pairs of ids that are both in several packages."""
    blocks = materialize(_blocks(_sets(has, n), n), "blocks")
    sets = materialize(_sets(wants, n).select("_in", "twice", F.col("ids").alias("dsts"), _bits(n).alias("bits")), "sets")
    one = sets.groupBy("_in").agg(F.sum(F.size("dsts")).alias("a"), F.max(F.size("bits")).alias("most"))
    other = blocks.groupBy("_in").agg(F.sum(F.size(F.flatten("ids"))).alias("b"))
    cells = materialize(one.join(other, "_in").select("_in", "most", F.ceil(F.col("a").cast("double") * F.col("b") / PAIRS).cast("int").alias("cells")), "cells")
    most, parts = cells.agg(F.max("most"), F.sum("cells")).first()
    parts = min(MOST_PARTS, max(parts or 1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = F.get("dsts", F.lit(0))
    on, near = ["_in"], broadcast_if_small(blocks)
    if near is blocks:  # an interface goes to one cell of its package, a block to all of them
        cells = broadcast_if_small(cells.select("_in", "cells"))
        sets = sets.join(cells, "_in").withColumn("cell", F.pmod(F.xxhash64(first), "cells").cast("int")).drop("cells")
        near = blocks.join(cells, "_in").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
        on = ["_in", "cell"]
        sets, near = sets.repartition(parts, *on), near.repartition(parts, *on)
    else:
        sets = sets.repartition(parts, first)
    both = F.col("i.twice") & F.col("t.twice")
    return _met(sets, near, most or 0, on, ~both), _met(sets.where("twice"), near.where("twice"), most or 0, on, both)


def _counted(wants: DataFrame, has: DataFrame, often: DataFrame) -> DataFrame:
    """(src, dst) of packages in which methods share bits, from rows without repeats; a pair comes once for each of its packages."""
    n = WIDE // WORD
    bits = materialize(often.select("_in", "method", "n", F.pmod(F.xxhash64("method"), F.lit(n * WORD)).cast("int").alias("bit")), "bits")
    found = wants.join(bits, ["_in", "method"], "left")
    ranked = found.groupBy("_in", "id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "method")).alias("least"), F.count("*").alias("size"))
    ranked = ranked.where("least.n > 0").join(_words(found, n, "w").where("NOT open"), ["_in", "id"])
    key = ranked.withColumnRenamed("id", "dst").select("_in", "dst", "size", F.col("least.method").alias("method"), *(f"w{k}" for k in range(n)))
    sets = has.join(_words(has.join(bits, ["_in", "method"]), n, "h").drop("open"), ["_in", "id"]).withColumnRenamed("id", "src")
    fits: Column = reduce(lambda a, b: a & b, (F.col(f"h{k}").bitwiseAND(F.col(f"w{k}")) == F.col(f"w{k}") for k in range(n)))
    key, sets = materialize(key, "containment"), materialize(sets, "containment")
    met = lambda on: key.where(on).join(sets, ["_in", "method"]).where(fits)
    open_ = met("size > 1").select("_in", "dst", "size", "src").join(wants.withColumnRenamed("id", "dst"), ["_in", "dst"])
    rest = open_.join(has.withColumnRenamed("id", "src"), ["_in", "src", "method"], "left_semi").groupBy("_in", "src", "dst", "size").count()
    return met("size = 1").select("src", "dst").unionByName(rest.where(F.col("count") == F.col("size")).select("src", "dst"))


def implements(interfaces: DataFrame, types: DataFrame, by: str = "package") -> DataFrame:
    """(src, dst, relation): a type (src) and each interface (dst) of its package whose methods it has, in whatever files.

    Both tables have (package, id, method), a row for each method, and are read more than once. In a package of at most WIDE methods a bit
    is a method. Equal sets are one row there, and types lie in blocks of 64: a block has a mask for each method, and the masks of the
    methods of an interface, rarest first, leave the types that have them all. Pairs that fail are no rows. In a larger package an
    interface is looked for under the method of its own that the fewest types have; methods share bits, and what passes is counted method
    by method. Interfaces without methods are satisfied by nothing here; repeated rows count once, rows with a null are left out; packages
    that are null are one."""
    clean = lambda df: df.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("_in"), "id", "method").where("id IS NOT NULL AND method IS NOT NULL")
    wants, has = clean(interfaces), clean(types)
    often = materialize(has.groupBy("_in", "method").agg(F.count("*").alias("n")), "methods")
    sizes = materialize(often.groupBy("_in").agg(F.count("*").alias("methods")), "sizes")
    small = sizes.where(F.col("methods") <= WIDE).select("_in")
    most, = sizes.where(F.col("methods") <= WIDE).agg(F.max("methods")).first()
    large = not sizes.where(F.col("methods") > WIDE).isEmpty()
    n = max(1, -(-(most or 0) // WORD))
    # only packages of few methods are numbered, so that no window is large
    place = F.row_number().over(Window.partitionBy("_in").orderBy("n", "method")) - 1
    bits = broadcast_if_small(materialize(often.join(small, "_in", "left_semi").select("_in", "method", place.alias("bit")), "bits"))
    # a method that no type has leaves its interface without candidates
    some = materialize(_words(wants.join(bits, ["_in", "method"], "left"), n, "w").where("NOT open").drop("open"), "wants")
    own = materialize(_words(has.join(bits, ["_in", "method"]), n, "w").drop("open"), "has")
    out = None
    more_wants, more_has = [], []
    if large:
        rest = sizes.where(F.col("methods") > WIDE).select("_in")
        more_wants, more_has = ([materialize(x.join(rest, "_in", "left_semi").distinct(), "rows")] for x in (wants, has))
        out = _counted(*more_wants, *more_has, often.join(rest, "_in", "left_semi"))
    # a pair can come twice only if both its ends are in several packages
    twice = [_several(own, *(x.select("_in", "id").distinct() for x in more_has))]
    if repeated := not twice[0].isEmpty():
        twice.append(_several(some, *(x.select("_in", "id").distinct() for x in more_wants)))
    mark = lambda df, t: df.join(t, "id", "left").withColumn("twice", F.coalesce("twice", F.lit(False))) if repeated else df.withColumn("twice", F.lit(False))
    once, more = _decided(mark(some, twice[-1]), mark(own, twice[0]), n)
    if repeated:
        once = once.unionByName((more.unionByName(out) if large else more).distinct())
    elif large:
        once = once.unionByName(out)
    return once.withColumn("relation", F.lit("implements"))
