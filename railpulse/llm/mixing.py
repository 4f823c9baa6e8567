"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railpulse.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 16
MAX_REPEATS = 3
SHARD_DOCS = 1_000
SEED = "mix-1"


def words_of(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = MAX_REPEATS) -> DataFrame:
    """Target per source: shares by weight of the total size, at most ``repeats`` sizes.

    Takes (source, source_size). Sources in order of code point, NULL last, get the
    weights in turn. What a capped source leaves goes to the others by weight. With
    the sources ordered by cap per weight, the capped ones come first; the level is
    what the caps before leave of the total, over the weight still to serve.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("_weight", F.element_at(turn, ((F.row_number().over(everything) - 1) % len(weights) + 1)))
    s = s.withColumn("_cap", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("_left", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.sum("_weight").over(after))
    # The level rises from one capped source to the next and falls after the last: its peak is that of the rest.
    peak = F.max("_level").over(whole)
    return s.select("source", "source_size", F.least("_cap", peak * F.col("_weight")).alias("target"))


def apportion(votes: DataFrame, group: list[str], vote: str, seats: str, order: str, out: str) -> DataFrame:
    """Deal the ``seats`` of each group by the highest quotients vote / (2 k - 1).

    A divisor slightly above the mean vote per seat gives everybody a number of
    seats that is safe; the quotients left to compare are about two per party.
    Ties go to the smaller ``order``.
    """
    g = Window.partitionBy(*group)
    v = votes.withColumn("_votes", F.sum(vote).over(g)).withColumn("_parties", F.count(F.lit(1)).over(g))
    fair = F.col(vote) * F.col(seats) / F.col("_votes")
    slack = F.col("_parties") / (2.0 * F.col(seats)) + F.lit(1e-9)
    able = (F.col("_votes") > 0) & (F.col(seats) > 0)
    v = v.withColumn("_base", F.when(able, F.greatest(F.lit(0.0), F.floor(fair * (1 - slack) + 0.5))).otherwise(0.0).cast("long"))
    v = v.withColumn("_most", F.when(able, F.floor(fair * (1 + slack) + 0.5)).otherwise(0.0).cast("long"))
    v = v.withColumn("_free", F.col(seats) - F.sum("_base").over(g))
    steps = F.when(F.col("_most") > F.col("_base"), F.sequence(F.col("_base") + 1, F.col("_most"))).otherwise(
        F.array().cast("array<bigint>")
    )
    keys = [*group, order]
    quotients = v.select(*keys, "_free", vote, F.explode(steps).alias("_seat")).withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy(*group).orderBy(
                (F.col(vote) / (2.0 * F.col("_seat") - 1.0)).desc(), F.col(order).asc_nulls_last(), "_seat"
            )
        ),
    )
    won = quotients.where(F.col("_rank") <= F.col("_free")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    won = won.select("_won", *[F.col(k).alias(f"_won_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_won_{k}"))
    return v.join(won, same, "left").select(
        *votes.columns, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias(out)
    )


def mix_sources(docs: DataFrame, *args, **settings) -> DataFrame:
    """How many words a mix of the sources takes from each document: ``mix_spans`` without the spans."""
    return mix_spans(docs, *args, **settings).drop("spans")


def mixed_text(text: Column, spans: Column) -> Column:
    """The words that a mix takes of a text, each span as often as it is taken, with one blank between words."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def taken(s: Column) -> Column:
        part = F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        return F.flatten(F.array_repeat(part, s["repeats"].cast("int")))

    return F.array_join(F.flatten(F.transform(spans, taken)), " ")


def mix_spans(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Which words a mix of the sources takes from each document, and how many.

    The total size is cut into blocks of ``block_words`` words. Sainte-Laguë deals
    the blocks to the sources by their targets and, within a source, to its shards
    by their sizes. A shard is a line of words: its documents in seeded order. Its
    quota goes to the blocks of that line evenly, from a seeded offset on, at most
    ``repeats`` times each; a document takes the words of its part of the line.

    Returns doc_id, size, source_size, target, taken, spans, and the columns in ``keep``.
    ``spans`` are the chosen runs of words in order: words start to end, from 0 and
    without the end, are taken ``repeats`` times. They add up to ``taken``.
    NULL and blank texts have size 0 and take nothing. NULL is a source of its own.
    Repeated rows are documents of their own. No rows give no rows. Columns of
    other names are not read.
    """
    # The draw of a row: seeded, the same in every run and order of rows. Texts without
    # doc_id differ in it; rows equal in all columns share it and are interchangeable.
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text", *[F.col(c).cast("string") for c in keep if c != "text"])
    rows = docs.select(
        F.col("doc_id"), F.col("source"), words_of(F.col("text")).alias("size"), draw.alias("_draw"), *[F.col(c).alias(f"_keep_{c}") for c in keep]
    )
    small = stage(rows.select("doc_id", "source", "size", "_draw"), "mix-sizes")
    by_source = small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    by_source = stage(by_source, "mix-sources")
    targets = source_targets(by_source.select("source", "source_size"), weights, repeats)
    total = F.sum("source_size").over(Window.partitionBy())
    seats = targets.withColumn("_seats", F.round(total / block_words).cast("long")).withColumn("_all", F.lit(0))
    quotas = apportion(seats, ["_all"], "target", "_seats", "source", "_quota").drop("_all", "_seats")
    docs_of = by_source.select(F.col("source").alias("_source"), F.ceil(F.col("_docs") / shard_docs).alias("_shards"))
    quotas = stage(
        quotas.join(docs_of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "mix-quotas"
    ).withColumnRenamed("source", "_source")

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(quotas, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
            "_shard", F.pmod(F.xxhash64(F.lit("shard"), "_draw"), F.col("_shards"))
        )

    shards = dealt(small).groupBy("source", "_shard", "_quota").agg(F.sum("size").alias("_shard_size"))
    shares = apportion(shards, ["source"], "_shard_size", "_quota", "_shard", "_share")
    blocks = F.ceil(F.col("_shard_size") / block_words)
    shares = stage(
        shares.select(
            F.col("source").alias("_of"),
            F.col("_shard").alias("_part"),
            blocks.alias("_blocks"),
            F.least("_share", blocks * repeats).alias("_share"),
        ),
        "mix-shards",
    )
    line = Window.partitionBy("source", "_shard").orderBy("_draw", F.col("doc_id").asc_nulls_last(), "size")
    r = dealt(rows if keep else small)
    r = r.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.join(shares, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_shard") == F.col("_part")))
    # Words of the line taken before a place. Block b is taken floor((b + 1) q + o) - floor(b q + o) times,
    # where q is quota over blocks: before block b lie floor(b q + o) - floor(o) takings.
    offset = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), F.lit(1 << 20)) / float(1 << 20)

    def takings(block: Column) -> Column:
        return F.floor((block * F.col("_share")) / F.col("_blocks") + offset)

    def taken_before(place: Column) -> Column:
        block = F.floor(place / block_words)
        return takings(block) * block_words + (place - block * block_words) * (takings(block + 1) - takings(block))

    end = F.col("_end")
    taken = F.when(F.col("size") > 0, taken_before(end) - taken_before(end - F.col("size"))).otherwise(0)
    begin = end - F.col("size")

    def span(block: Column) -> Column:
        return F.struct(
            F.greatest(block * block_words - begin, F.lit(0)).cast("long").alias("start"),
            F.least((block + 1) * block_words - begin, F.col("size")).cast("long").alias("end"),
            (takings(block + 1) - takings(block)).cast("long").alias("repeats"),
        )

    blocks = F.sequence(F.floor(begin / block_words), F.floor((end - 1) / block_words))
    spans = F.when(F.col("size") > 0, F.filter(F.transform(blocks, span), lambda s: s["repeats"] > 0))
    none = F.array().cast("array<struct<start:bigint,end:bigint,repeats:bigint>>")
    return r.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.coalesce(spans, none).alias("spans"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
