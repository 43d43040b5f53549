"""Mixing sources to target weights.

Every source gets a target in words. Its documents fall into hashed blocks, and
its quota of block draws is exact: whole passes over all blocks, then blocks in a
permuted order up to what remains; in the block where that ends, documents in
permuted order. A splitting tree deals the draws to output shards: all draws are put in one
random order, each node has a run of it, and half of the run goes to either child. Half of a random order is a draw
without replacement, which makes the children's source counts multivariate hypergeometric given their parent's,
so every shard has the mix of the whole. Blocks are disjoint, and each shard is
put in random order by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternflow.llm.common import count_words, ref, staged, whole_text

#: Weights of the sources in code point order, repeating; null is last.
WEIGHTS = (3, 1, 2)
#: The mix is this part of all words, and no source more than so many times its own.
SHARE = 1.5
MOST = 2
#: Hexadecimal digits of a document's hash that name its block: 4096 blocks a source.
BLOCK_DIGITS = 3
#: Words that a shard holds on average, at most.
SHARD_WORDS = 1 << 24
FEWEST_LEVELS = 3
#: Hexadecimal digits of a draw's random key by which draws are ranked in parts: 4096 of them.
RANK_DIGITS = 3
SEED = "mix"


def _order_key(*parts: Column | str) -> Column:
    """A pseudo-random key that is the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def source_targets(
    sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``sizes`` (source, source_size and any others) with weight and target.

    Targets are proportional to the weights, but none is above ``most`` times its source's
    size: in the order in which sources reach that bound, the first level of words per weight
    that the remaining sources can take is the one for all of them. One row per source,
    so the single-partition windows stay as small as the list of sources.
    """
    everything = Window.partitionBy(F.lit(0))
    by_code_point = everything.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_code_point) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place)).withColumn(
        "cap", most * F.col("source_size")
    )
    by_bound = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_bound.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumns(
        {
            "place": F.row_number().over(by_bound),
            "level": (F.lit(share) * F.sum("source_size").over(everything) - before) / left,
        }
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))
    first = levelled.withColumn("first", F.min(fits).over(everything))
    target = F.when(F.col("place") >= F.col("first.place"), F.col("first.level") * F.col("weight"))
    return first.select(
        *sizes.columns, "weight", F.coalesce(target, F.col("cap").cast("double")).alias("target")
    )


def _draws(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per draw of a block: source key, block, pass, and room where the quota ends inside it."""
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    order = Window.partitionBy("skey").orderBy(_order_key("block", F.col("skey"), F.col("block")), "block")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = blocks.join(targets, "skey").withColumns(
        {"passes": passes.cast("int"), "before": before}
    )
    room = F.col("target") - F.col("passes") * F.col("source_size") - F.col("before")
    # A pass over every block has room for all of it; the last pass for what is left.
    whole = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(MOST)), lambda p: p < F.col("passes")),
        lambda p: F.struct(p.alias("pass"), F.lit(None).cast("double").alias("room")),
    )
    last = F.when(
        room > 0,
        F.array(
            F.struct(
                F.col("passes").alias("pass"), F.when(F.col("words") > room, room).alias("room")
            )
        ),
    ).otherwise(F.array().cast("array<struct<pass:int,room:double>>"))
    return quota.withColumn("d", F.explode(F.concat(whole, last))).select("skey", "block", "d.pass", "d.room")


def _ranked(draws: DataFrame) -> DataFrame:
    """The draws with their rank in one random order and their number, ``draws_before`` and ``n_draws``.

    Ranks are counted inside parts of the key, and parts from a table of one row for each of them, so no task ever sees all draws.
    """
    key = _order_key("split", F.col("skey"), F.col("block"), F.col("pass"))
    keyed = draws.withColumn("key", key).withColumn("part", F.substring("key", 1, RANK_DIGITS))
    everything = Window.partitionBy(F.lit(0))
    before = F.sum("n").over(everything.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(everything).alias("n_draws"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key", "skey", "block", "pass")) - 1
    ranked = keyed.join(F.broadcast(parts), "part")  # at most 16 ** RANK_DIGITS rows
    return ranked.withColumn("draws_before", inside + F.col("before")).drop("key", "part", "before")


def _split(draws: DataFrame, levels: int) -> DataFrame:
    """The draws with their shard: at every node the first half of its run goes left."""

    def down(node: Column, _: Column) -> Column:
        half = F.floor(node["n"] / 2)
        left = node["rank"] < half
        return F.struct(
            (2 * node["shard"] + F.when(left, 0).otherwise(1)).alias("shard"),
            F.when(left, node["rank"]).otherwise(node["rank"] - half).alias("rank"),
            F.when(left, half).otherwise(node["n"] - half).alias("n"),
        )

    top = F.struct(
        F.lit(0).cast("long").alias("shard"), F.col("draws_before").cast("long").alias("rank"), F.col("n_draws").cast("long").alias("n")
    )
    shard = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), top, down, lambda node: node["shard"].cast("int"))
    return _ranked(draws).withColumn("shard", shard).drop("draws_before", "n_draws")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per input row: identifier, source, size, source_size, target, copies, taken.

    ``size`` is the text's number of words (0 for null); ``copies`` is an array of
    (pass, shard) with an entry for each time the mix takes the row, ``taken`` the words
    that makes. Null is a source like any other, the last. A row without words is copied
    with its block and takes nothing. Rows that repeat share a block and are told apart
    only by their order in it. Other columns of the input are ignored. The same input
    gives the same mix in every run.
    """
    source = ref(source_col).cast("string")
    sized = staged(
        df.select(
            ref(id_col).alias("id"),
            source.alias("source"),
            F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("skey"),
            _order_key("row", F.coalesce(ref(id_col).cast("string"), F.lit(""))).alias("key"),
            count_words(whole_text(text_col)).alias("size"),
        ).withColumn("block", F.substring("key", 1, BLOCK_DIGITS)),
        "mix-sizes",
    )
    # Sums per block first: the hot source arrives as a few thousand rows.
    blocks = staged(sized.groupBy("skey", "source", "block").agg(F.sum("size").alias("words")), "mix-blocks")
    sizes = blocks.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    targets = staged(source_targets(sizes, weights=weights, share=share), "mix-targets")
    total = targets.agg(F.sum("target")).first()[0] or 0
    levels = max(FEWEST_LEVELS, math.ceil(math.log2(max(1, total / shard_words))))
    # Written, as the ranks need it twice.
    draws = _split(staged(_draws(blocks.select("skey", "block", "words"), targets), "mix-draws"), levels)
    drawn = draws.groupBy("skey", "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard", "room"))).alias("draws")
    )
    by_block = (
        blocks.select("skey", "block")
        .join(targets.select("skey", "source_size", "target"), "skey")
        .join(drawn, ["skey", "block"], "left")
    )
    inside = Window.partitionBy("skey", "block").orderBy("key", "id", "size")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The word nearest to where the room ends decides whether the row there is in.
    taken_by = F.filter(
        F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,room:double>>")),
        lambda d: d["room"].isNull() | (2 * F.col("before") + F.col("size") <= 2 * d["room"]),
    )
    return (
        sized.join(by_block, ["skey", "block"])
        .withColumn("before", before)
        .withColumn("copies", F.transform(taken_by, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))))
        .select(
            F.col("id").alias(id_col),
            F.col("source").alias(source_col),
            "size",
            "source_size",
            "target",
            "copies",
            (F.size("copies") * F.col("size")).cast("long").alias("taken"),
        )
    )


def place_key(id_col: str, number: Column) -> Column:
    """The random order of copies inside a shard, ``number`` being their pass."""
    return _order_key("place", F.coalesce(ref(id_col).cast("string"), F.lit("")), number)


def shard_rows(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per copy the mix takes: shard, identifier, pass; each shard in random order.

    A shard is one partition of bounded size, sorted on its own.
    """
    copies = mixed.select(ref(id_col), F.explode("copies").alias("c")).select(
        F.col("c.shard").alias("shard"), ref(id_col), F.col("c.pass").alias("pass")
    )
    return copies.repartition("shard").sortWithinPartitions("shard", place_key(id_col, F.col("pass")))
