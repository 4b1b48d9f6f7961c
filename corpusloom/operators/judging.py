"""Work for hosted models as tables: what is to be sent, in which portions, what came back, what it cost.

Sending is left to others: requests leave as lines of JSON, results come back as lines of JSON.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors

#: An article that failed so often isn't sent again; so many decided ones make the measured cost count.
MOST_ATTEMPTS, LEAST_MEASURED = 3, 1000


def targets(docs: DataFrame, band: DataFrame, strata: tuple[str, ...], ids: DataFrame | None = None) -> DataFrame:
    """Documents without error in the strata, only those of ``ids`` if given."""
    rows = docs.where("error IS NULL").join(band.where(F.col("stratum").isin(*strata)).select("event_id", "stratum"), "event_id")
    return rows if ids is None else rows.join(ids.select("event_id").distinct(), "event_id", "left_semi")


def state(results: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, decided, failures, given_up, spent) of every article that has results."""
    won = F.col("status") == "succeeded"
    rows = results.groupBy(key).agg(F.bool_or(won).alias("decided"), F.count_if(~won).alias("failures"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("spent"))
    return rows.select(key, "decided", "failures", (~F.col("decided") & (F.col("failures") >= MOST_ATTEMPTS)).alias("given_up"), "spent")


def totals(states: DataFrame) -> DataFrame:
    """One row: decided, given_up, spent, per_article (null if none is decided)."""
    t = states.agg(F.count_if("decided").alias("decided"), F.count_if("given_up").alias("given_up"), F.coalesce(F.sum("spent"), F.lit(0.0)).alias("spent"))
    return t.withColumn("per_article", F.try_divide(F.col("spent"), F.col("decided").cast("double")))


def undecided(wanted: DataFrame, states: DataFrame, in_flight: DataFrame | None = None, key: str = "event_id") -> DataFrame:
    """Articles that are to be sent."""
    rows = wanted.join(states.where("decided OR given_up").select(key), key, "left_anti")
    return rows if in_flight is None else rows.join(in_flight.select(key).distinct(), key, "left_anti")


def projected(total: DataFrame, wanted: int, estimate: float, budget: float) -> DataFrame:
    """One row: what all will cost, by the measured cost once enough are decided, else by the estimate; and whether that
    is over the budget."""
    per = F.when(F.col("decided") >= LEAST_MEASURED, F.col("per_article")).otherwise(F.lit(estimate))
    cost = F.col("spent") + per * (F.lit(wanted) - F.col("decided"))
    return total.select(cost.alias("projected"), (cost > budget).alias("over"))


def token_cost(tokens_in: Column, cache_read: Column, cache_write: Column, tokens_out: Column, prices: tuple[float, float], read: float = 0.1, write: float = 1.25, batch: bool = True) -> Column:
    """Dollars; ``prices`` a million tokens in and out, cache reads and writes as multiples of the price in."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = (zero(tokens_in) * prices[0] + zero(cache_read) * prices[0] * read + zero(cache_write) * prices[0] * write + zero(tokens_out) * prices[1]) / 1e6
    return full / 2 if batch else full


def first_batch(df: DataFrame, order: str, size: Column, most_bytes: int, most_rows: int = 100_000) -> DataFrame:
    """The longest beginning of df, in the order, that is within both limits; one row at least.

    At most ``most_rows`` rows can be in it, so no more are put in order together."""
    top = df.withColumn("_size", size).orderBy(order).limit(most_rows)
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("_sum", F.sum("_size").over(w)).withColumn("_rn", F.row_number().over(Window.orderBy(order))).where((F.col("_rn") == 1) | (F.col("_sum") <= most_bytes)).drop("_size", "_sum", "_rn")


#: Rows that a task of ``portions`` works on at once, as a power of two.
BLOCK_BITS = 13
#: Blocks whose outcomes are composed at once, as a power of two.
FAN_BITS = 6


def _break(sizes: list[float], at: int, held: float, most: float) -> tuple[int, float]:
    """(first row from ``at`` on that begins a portion, if ``held`` is in the open one; what is then held)."""
    for i in range(at, len(sizes)):
        if held and held + sizes[i] > most:
            return i, held
        held += sizes[i]
    return len(sizes), held


def _outcomes(sizes: list[float], most: float) -> tuple[list[float], list[int], list[float]]:
    """(sizes up to the last row at which the first portion of the block can begin; for each of them how many more
    portions the block then begins, and what is held at its end)."""
    head = sizes[: _break(sizes, 0, 0.0, most)[0] + 1]
    known: dict[int, tuple[int, float]] = {}
    for start in range(len(head)):
        path, at = [], start
        while at not in known:
            after, held = _break(sizes, at, 0.0, most)
            path.append(at)
            if after == len(sizes):
                known[at] = (0, held)
            else:
                at = after
        breaks, held = known[at]
        for x in reversed(path):
            if x not in known:
                breaks += 1
                known[x] = (breaks, held)
    return head, [known[j][0] for j in range(len(head))], [known[j][1] for j in range(len(head))]


def _passed(held: np.ndarray, head: list[float], breaks: list[int], tails: list[float], most: float) -> tuple[np.ndarray, np.ndarray]:
    """(portions that a block begins, what is held at its end) for each of several amounts held before it."""
    more, after, held = np.zeros(len(held), np.int64), np.zeros(len(held)), held.copy()
    walking = np.ones(len(held), bool)
    for s, b, t in zip(head, breaks, tails):
        stop = walking & (held != 0) & (held + s > most)
        more[stop], after[stop] = 1 + b, t
        walking &= ~stop
        if not walking.any():
            break
        held[walking] += s
    return more, np.where(walking, held, after)


def _composed(blocks: list[tuple], most: float) -> tuple[list[float], list[int], list[float]]:
    """The outcomes of blocks that follow each other, as of one block."""
    head: list[float] = []
    numbers, held = np.zeros(0, np.int64), np.zeros(0)
    at, begun = 0.0, False
    for sizes, breaks, tails in blocks:
        more, held = _passed(held, sizes, breaks, tails, most)
        numbers = numbers + more
        if not begun:
            j, at = _break(sizes, 0, at, most)
            begun, j = j < len(sizes), min(j + 1, len(sizes))
            head += sizes[:j]
            numbers, held = np.concatenate([numbers, breaks[:j]]), np.concatenate([held, tails[:j]])
    return head, numbers.astype(int).tolist(), held.tolist()


def portions(df: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """df's (group, order) with ``portion``, from 0 in each group: rows in order as long as the sum of their sizes stays
    within ``most``, then the next portion; a larger row stands alone. A null size counts as 0.

    Groups may be of any size: rows are put in order by ranges and cut into blocks. For each row of a block that can be
    the first to begin a portion, a task says where that leads. These outcomes are composed up a tree of blocks, at most
    ``2 ** FAN_BITS`` at a time, and from its top every block learns the portion that it starts in. So the result is that
    of one walk through the group, and no task sees more of a group than the blocks below one node."""
    slim = df.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(size.cast("double"), F.lit(0.0)).alias("s"))
    kinds, fan = dict(slim.dtypes), FAN_BITS
    # checkpointed, since the rows' places must be the same in both passes
    placed = slim.repartitionByRange("g", "o").sortWithinPartitions("g", "o", "s").withColumn("at", F.monotonically_increasing_id()).checkpoint()
    # an id is the number of a partition and, in its low 33 bits, that of a row in it
    part, row = F.shiftright("at", 33), F.shiftright(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), BLOCK_BITS)
    last = placed.agg(F.max(part).alias("part"), F.max(row).alias("row")).first()
    inner = (last["row"] or 0).bit_length()
    levels = max(1, -(-((last["part"] or 0).bit_length() + inner) // fan))
    rows = placed.withColumn("block", F.shiftleft(part, inner).bitwiseOR(row))
    outcome = f"g {kinds['g']}, block long, head array<double>, breaks array<long>, tails array<double>"
    each = ["head", "breaks", "tails"]

    def frame(x: pd.DataFrame, block: int, found: tuple) -> pd.DataFrame:
        return pd.DataFrame({"g": x["g"].iloc[:1].tolist(), "block": [block]} | {c: [v] for c, v in zip(each, found)})

    def summary(x: pd.DataFrame) -> pd.DataFrame:
        return frame(x, x["block"].iloc[0], _outcomes(x.sort_values("at")["s"].tolist(), most))

    def compose(x: pd.DataFrame) -> pd.DataFrame:
        below = [tuple(v.tolist() for v in r) for r in x.sort_values("block")[each].itertuples(index=False)]
        return frame(x, x["block"].iloc[0] >> fan, _composed(below, most))

    def descend(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("block")
        number, held, found = int(x["number"].iloc[0]), x["held"].to_numpy()[:1].astype(float), []
        for head, breaks, tails in x[each].itertuples(index=False):
            found.append((number, float(held[0])))
            more, held = _passed(held, head, breaks, tails, most)
            number += int(more[0])
        return x[["g", "block"]].assign(number=[n for n, _ in found], held=[h for _, h in found])

    def numbered(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("at")
        number, held, found = int(x["number"].iloc[0]), float(x["held"].iloc[0]), []
        for s in x["s"]:
            if held and held + s > most:
                number, held = number + 1, 0.0
            held += s
            found.append(number)
        return x.assign(portion=found)[["g", "o", "portion"]]

    def under(x: DataFrame, starts: DataFrame, node: Column) -> DataFrame:
        known = starts.select(F.col("g").alias("_g"), F.col("block").alias("_block"), "number", "held")
        return x.join(known, F.col("g").eqNullSafe(F.col("_g")) & (node == F.col("_block"))).drop("_g", "_block")

    node = F.shiftright("block", fan)
    tree = [rows.groupBy("g", "block").applyInPandas(summary, outcome)]
    for _ in range(1, levels):
        # a level is read going up and going down
        tree[-1] = tree[-1].checkpoint()
        tree.append(tree[-1].groupBy("g", node.alias("node")).applyInPandas(compose, outcome))
    starts = None
    for level in reversed(tree):
        held = level.withColumns({"number": F.lit(0).cast("bigint"), "held": F.lit(0.0)}) if starts is None else under(level, starts, node)
        starts = held.groupBy("g", node.alias("node")).applyInPandas(descend, f"g {kinds['g']}, block long, number long, held double")
    done = under(rows, starts, F.col("block")).groupBy("g", "block").applyInPandas(numbered, f"g {kinds['g']}, o {kinds['o']}, portion long")
    return done.select(F.col("g").alias(group), F.col("o").alias(order), "portion")


def embed_requests(df: DataFrame, key: str, text: Column, dims: int) -> DataFrame:
    """(line): a request for an embedding of each row, as JSON."""
    content = F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.struct(content.alias("content"), F.lit(dims).alias("output_dimensionality")).alias("request"))).alias("line"))


def judge_requests(df: DataFrame, key: str, text: Column, model: str, system: str, schema: str, most_tokens: int = 4000) -> DataFrame:
    """(line): a request for a judgement of each row, as JSON. ``schema`` is the answer's JSON schema."""
    params = F.struct(
        F.lit(model).alias("model"), F.lit(most_tokens).alias("max_tokens"),
        F.array(F.struct(F.lit("text").alias("type"), F.lit(system).alias("text"), F.struct(F.lit("ephemeral").alias("type")).alias("cache_control"))).alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"),
        F.struct(F.struct(F.lit("json_schema").alias("type"), F.parse_json(F.lit(schema)).alias("schema")).alias("format")).alias("output_config"),
    )
    return df.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), params.alias("params"))).alias("line"))


VECTOR_LINE = "struct<key:string,error:string,response:struct<embedding:struct<`values`:array<float>>,embeddings:array<struct<`values`:array<float>>>>>"


def embedded(lines: DataFrame, dims: int, line: str = "value") -> DataFrame:
    """(key, vector, error) of lines that came back: a vector of the right length and finite, else what is wrong."""
    r = lines.select(F.from_json(line, VECTOR_LINE).alias("r")).select("r.*")
    v = F.coalesce(F.col("response.embedding.values"), F.get(F.col("response.embeddings"), F.lit(0))["values"])
    good = vectors.valid(v, dims)
    length = F.coalesce(F.size(v), F.lit(0))
    wrong = F.concat(F.lit("bad vector of length "), F.greatest(length, F.lit(0)).cast("string"))
    return r.select("key", F.when(F.col("error").isNull() & good, v).alias("vector"), F.when(F.col("error").isNotNull(), F.left("error", F.lit(300))).when(~good, wrong).alias("error"))


ANSWER = "struct<in_scope:boolean,clauses:array<bigint>,evidence:string,confidence:string>"


def judged(results: DataFrame, answer: str = "answer") -> DataFrame:
    """results with in_scope, clauses (sorted, each once), evidence and confidence read from a JSON answer; a result that
    succeeded but can't be read has status unparsed."""
    rows = results.withColumn("_a", F.from_json(answer, ANSWER))
    read = (F.col("status") == "succeeded") & F.col("_a.in_scope").isNotNull() & F.col("_a.clauses").isNotNull()
    status = F.when((F.col("status") == "succeeded") & ~F.coalesce(read, F.lit(False)), "unparsed").otherwise(F.col("status"))
    take = lambda c: F.when(read, c)
    return rows.select(
        *[c for c in results.columns if c not in ("status", answer)], status.alias("status"), take(F.col("_a.in_scope")).alias("in_scope"), take(F.sort_array(F.array_distinct("_a.clauses"))).alias("clauses"), take(F.col("_a.evidence")).alias("evidence"), take(F.col("_a.confidence")).alias("confidence")
    )
