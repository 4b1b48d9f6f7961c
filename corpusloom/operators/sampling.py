"""Stratified draws and their dealing to coders, in the order of a hash that any engine can compute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(seed: str, key: Column) -> Column:
    """MD5 of "seed:key"; ties are rows with equal keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def allocation(population: DataFrame, stratum: str, source: str, quotas: dict[str, int], least: int) -> DataFrame:
    """(stratum, source, size, seats): ``quotas`` seats of each stratum over its sources. A source gets min(least, size), and
    of the seats that are left a share in proportion to its size, as far as it has room.

    So shares are min(room, level * size) with one level for the stratum, which follows from the sources in the order in
    which they fill up: of those that don't, the level is what is left for them by their size. Parts of seats go to the
    largest, ties to the greatest name. All of it is whole numbers, windows over a row a source, and no seat is over."""
    seats = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("stratum")], F.lit(0)) if quotas else F.lit(0)
    all_of, upto = Window.partitionBy("stratum"), Window.partitionBy("stratum").orderBy("fill", "source")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    sizes = population.groupBy(F.col(stratum).alias("stratum"), F.col(source).alias("source")).agg(F.count("*").alias("size"))
    rows = sizes.withColumn("sure", F.least(F.lit(least).cast("bigint"), "size")).withColumn("room", F.col("size") - F.col("sure"))
    rows = rows.withColumn("rest", F.greatest(F.lit(0), seats - F.sum("sure").over(all_of))).withColumn("fill", F.col("room") / F.col("size"))
    rows = rows.withColumn("place", F.row_number().over(upto)).withColumn("left", F.col("rest") - F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("among", F.sum("size").over(all_of) - F.coalesce(F.sum("size").over(before), F.lit(0)))
    # the first source that doesn't fill up
    level = F.min(F.when(F.col("left") * F.col("size") <= F.col("room") * F.col("among"), F.struct("place", "left", "among"))).over(all_of)
    rows = rows.withColumn("level", level).withColumn("open", F.coalesce(F.col("place") >= F.col("level.place"), F.lit(False)))
    product = F.when(F.col("open"), F.greatest(F.lit(0), F.col("level.left")) * F.col("size"))
    rows = rows.withColumn("whole", F.coalesce(F.floor(product / F.col("level.among")), F.col("room"))).withColumn("part", F.coalesce(product % F.col("level.among"), F.lit(0)))
    over = F.greatest(F.lit(0), F.col("level.left")) - F.sum(F.when(F.col("open"), F.col("whole"))).over(all_of)
    first = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("part"), F.desc("source")))
    extra = F.when((F.col("part") > 0) & (first <= over), 1).otherwise(0)
    return rows.select("stratum", "source", "size", (F.col("sure") + F.col("whole") + extra).cast("bigint").alias("seats"))


def draw(population: DataFrame, key: str, stratum: str, source: str, seats: DataFrame, seed: str) -> DataFrame:
    """The first ``seats`` rows of each stratum and source in hash order, with their weight (rows each stands for)."""
    joined = population.join(F.broadcast(seats), (population[stratum] == seats["stratum"]) & (population[source] == seats["source"])).where("seats > 0")
    w = Window.partitionBy(seats["stratum"], seats["source"]).orderBy(order_of(seed, F.col(key)), key)
    ranked = joined.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("seats"))
    return ranked.select(population[key], population[stratum], population[source], F.round(F.col("size") / F.least("size", "seats"), 4).alias("weight"))


def positioned(sample: DataFrame, key: str, seed: str) -> DataFrame:
    """The sample with ``position`` from 0 in an order of its own. Samples are bounded by their quotas."""
    return sample.withColumn("position", F.row_number().over(Window.orderBy(order_of(f"{seed}/position", F.col(key)), key)) - 1)


def population(df: DataFrame, key: str, excluded: list[DataFrame]) -> DataFrame:
    """df without what was excluded or drawn before."""
    for x in excluded:
        df = df.join(x.select(key).distinct(), key, "left_anti")
    return df


def assign(sample: DataFrame, key: str, stratum: str, coders: list[str], shared: int, seed: str) -> DataFrame:
    """(key, coders, shared): ``shared`` rows, evenly over the strata, go to every coder, the rest in turn to one each.
    A sample is bounded by its quotas, so it is ordered as a whole."""
    w = Window.orderBy(stratum, order_of(seed, F.col(key)), key)
    placed = sample.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    # row i is shared if a multiple of n / shared falls on it
    at = lambda i: F.floor(i * F.lit(shared) / F.col("_n"))
    everyone = (at(F.col("_i") + 1) > at(F.col("_i"))) if shared else F.lit(False)
    placed = placed.withColumn("shared", everyone)
    turn = F.row_number().over(Window.partitionBy("shared").orderBy("_i")) - 1
    one = F.array(F.get(F.array(*map(F.lit, coders)), (turn % len(coders)).cast("int")))
    return placed.select(key, stratum, F.when(F.col("shared"), F.array(*map(F.lit, coders))).otherwise(one).alias("coders"), "shared")


def per_group(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each group, in hash order."""
    w = Window.partitionBy(group).orderBy(order_of(seed, F.col(key)), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def exactly(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows in hash order."""
    return df.orderBy(order_of(seed, F.col(key)), key).limit(n)
