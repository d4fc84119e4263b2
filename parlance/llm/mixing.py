"""Mixing sources to target weights, by highest-quotient (Sainte-Laguë) apportionment of equal-token blocks.

Everything runs as DataFrame operations. The texts are read once, to count words; what is shuffled
afterwards is a few numbers per document.

1.  Targets. Sources share `budget` times all words by weight; a target stops at `cap` times its
    source's size and the excess is shared again by weight (water filling, closed form over one row
    per source).
2.  Quotas. The targets are expressed in blocks of equal token count. Blocks go to sources by the
    highest quotients target / (k + 1/2), k blocks already given; a source's blocks go to its shards
    by the same rule on shard sizes. Only the quotients near the final divisor are ranked: the
    divisor lies between S / (N + P/2) and S / (N - P/2) for P parties, N blocks and votes S, which
    fixes all but about P of the blocks in advance.
3.  Selection. A shard holds its documents in a seeded order as one stream of tokens, cut into blocks.
    A quota of q over b blocks takes each block q div b times; the other q mod b blocks are those that
    follow a seeded offset, cyclically. A document's share is the overlap of its tokens with the
    chosen blocks, so at most two spans and `cap` copies of any word.

A source of a third of all rows has as many more shards, so no task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.runtime import materialize, packed, small_or_shuffled

WORD = r"[^\x20\x09-\x0D]+"

#: Documents of a shard, and the most shards of a source (so that a source's shards fit one window): beyond
#: SHARD_DOCS * MAX_SHARDS documents of a source its shards have more documents each.
SHARD_DOCS, MAX_SHARDS = 2048, 4096
#: Tokens of a block at most; smaller if the smallest target has fewer than MIN_BLOCKS of those.
MAX_BLOCK, MIN_BLOCKS = 1024, 1024


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but the six ASCII white-space characters); null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """60 bits of an MD5 of the parts joined by ':', as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def quotas(parties: DataFrame, within: list[str], votes: str, seats: str, order: list[Column], out: str, most: str | None = None) -> DataFrame:
    """Adds column `out`: the party's seats by highest quotient votes / (k + 1/2).

    within: columns of the groups among which `seats` (the same in all rows of a group) are dealt; ties
    go by `order`, which must be unique in a group. A party without votes gets none. most: column of the seats that a
    party may have; what it cannot take goes to the next highest quotients of others, which are ranked up to twice the number
    of parties beyond the seats, so that a party may be over its most by rounding only.
    """
    group = Window.partitionBy(*[F.col(c) for c in within]) if within else Window.partitionBy(F.lit(0))
    total, n = F.sum(F.col(votes).cast("double")).over(group), F.count(F.lit(1)).over(group)
    x = parties.withColumn("_s", total).withColumn("_n", n)
    share = F.when(F.col("_s") > 0, F.col(votes).cast("double") / F.col("_s")).otherwise(F.lit(0.0))
    low = F.floor(F.greatest(F.lit(0.0), share * (F.col(seats) - F.col("_n") / 2) - 0.5)).cast("long")
    ahead = F.col("_n") / 2 if most is None else 2 * F.col("_n") + 1
    high = F.when(F.col(votes) > 0, F.floor(share * (F.col(seats) + ahead) + 1.5).cast("long")).otherwise(F.lit(0).cast("long"))
    if most is not None:
        low, high = F.least(low, F.col(most)), F.least(high, F.col(most))
    x = x.withColumn("_low", F.when(F.col(votes) > 0, low).otherwise(F.lit(0).cast("long"))).withColumn("_high", F.greatest(high, F.col("_low")))
    x = x.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    keys = [c for c in parties.columns]
    near = x.withColumn("_k", F.explode_outer(F.expr("CASE WHEN _high > _low THEN sequence(_low, _high - 1) END")))
    ranked = near.withColumn(
        "_rank",
        F.row_number().over(group.orderBy(F.when(F.col("_k").isNull(), F.lit(-1.0)).otherwise(F.col(votes).cast("double") / (F.col("_k") + 0.5)).desc(), *order, F.col("_k"))),
    )
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    return ranked.groupBy(*keys, "_low").agg(won.alias("_won")).select(*keys, (F.col("_low") + F.col("_won")).alias(out))


def source_targets(sources: DataFrame, weight: Column | None = None, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size) with rank, weight and target.

    Sources are ranked by code point, null last; without `weight` they weigh 5, 2, 1, repeating.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("source_rank", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("weight", (weight if weight is not None else F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), ((F.col("source_rank") - 1) % 3 + 1).cast("int"))).cast("double"))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(cap)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    rising = everything.orderBy("_ratio", "source_rank")
    s = s.withColumn("_total", F.sum("source_size").over(everything) * F.lit(budget))
    before = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", (F.col("_total") - before) / rest)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_rank", "_level"))).over(everything)["_level"]
    s = s.withColumn("_at", first)
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("weight")))
    return s.withColumn("target", target).select("source", "source_size", "source_docs", "source_rank", "weight", "target")


def mix(docs: DataFrame, seed: str = "mix-1", budget: float = 1.5, cap: int = 2, weight: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_block: int = MAX_BLOCK, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, repeats, span1/span2 (start, length).

    taken = repeats * size + the lengths of the two spans of words (0-based, within the document), which are
    taken once more. The columns named are the only ones read; others may have any name. A null text has
    size 0; a null source is a source of its own; a null doc_id counts as an empty string. A row's shard and place hang
    on doc_id and text, so rows of one doc_id, or with none, are spread; rows that are equal in both are laid out one after
    the other, each in its own right. A very long text may be cut by the spans. An empty table gives an empty result.
    Sources of size 0 have target 0. The rows of all sources, and of all shards of a source, pass one task.
    """
    sized = materialize(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie"), seeded(F.lit(seed), F.col(doc_id), F.md5(F.col(text))).alias("at")),
        "mix-sized",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    s = source_targets(per_source, weight, budget, float(cap))
    everything = Window.partitionBy(F.lit(0))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    s = s.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(smallest / MIN_BLOCKS))), F.lit(1)).cast("long"))
    s = s.withColumn("blocks", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    s = s.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_docs") / F.lit(shard_docs)))).cast("long"))
    s = materialize(quotas(s, [], "target", "blocks", [F.col("source_rank")], "source_quota"), "mix-sources")
    plan = small_or_shuffled(s.drop("weight", "blocks", "source_docs").withColumnRenamed("source", "_source"))
    d = sized.join(plan, sized["source"].eqNullSafe(plan["_source"])).drop("_source").withColumn("shard", F.pmod(F.col("at"), F.col("shards")))
    per_shard = d.groupBy("source_rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    per_shard = per_shard.withColumn("n", F.ceil(F.col("shard_size") / F.col("block")).cast("long")).withColumn("_most", F.lit(cap) * F.col("n"))
    shards = quotas(per_shard, ["source_rank"], "shard_size", "source_quota", [F.col("shard")], "quota", "_most")
    shards = shards.withColumn("repeats", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long"))
    shards = shards.withColumn("_more", F.col("quota") - F.col("repeats") * F.col("n"))
    shards = shards.withColumn("_from", F.when(F.col("n") > 0, F.pmod(seeded(F.lit(seed), F.lit("offset"), F.col("source_rank"), F.col("shard")), F.col("n"))).otherwise(0))
    end = F.col("_from") + F.col("_more")
    shards = shards.select(
        "source_rank",
        "shard",
        "repeats",
        (F.col("_from") * F.col("block")).alias("_a1"),
        F.least(F.least(end, F.col("n")) * F.col("block"), F.col("shard_size")).alias("_b1"),
        (F.greatest(end - F.col("n"), F.lit(0)) * F.col("block")).alias("_b2"),
    )
    shards = small_or_shuffled(materialize(shards, "mix-shards"))
    stream = Window.partitionBy("source_rank", "shard").orderBy("at", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_end", F.sum("size").over(stream)).withColumn("_start", F.col("_end") - F.col("size"))
    d = d.join(shards, ["source_rank", "shard"])

    def overlap(a: Column, b: Column) -> tuple[Column, Column]:
        start = F.greatest(F.col("_start"), a)
        return start - F.col("_start"), F.greatest(F.least(F.col("_end"), b) - start, F.lit(0))

    one, two = overlap(F.col("_a1"), F.col("_b1")), overlap(F.lit(0), F.col("_b2"))
    span = lambda x: F.struct(F.when(x[1] > 0, x[0]).otherwise(0).cast("long").alias("start"), x[1].cast("long").alias("length"))
    d = d.withColumn("span1", span(one)).withColumn("span2", span(two))
    taken = (F.col("repeats") * F.col("size") + F.col("span1.length") + F.col("span2.length")).cast("long")
    return d.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "repeats", "span1", "span2", "tie")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mixture as rows of docs: whole texts `repeats` times, and each span of words taken once more (joined by one space).

    n_chars, where there is such a column, is that of the text returned. Documents of which nothing is
    taken go; so do rows without words. Repeated rows (same doc_id and text) all take the smallest of
    their plans, so that the result does not hang on their order.
    """
    plan = mix(docs, **how).select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "repeats", "span1", "span2", "taken")
    plan = plan.filter("taken > 0").groupBy("_id", "_tie").agg(F.min(F.struct("repeats", "span1", "span2")).alias("_p")).select("_id", "_tie", "_p.*")
    x = packed(docs).withColumn("_t", F.xxhash64("_row.text"))
    x = x.join(plan, F.col("_row.doc_id").eqNullSafe(plan["_id"]) & (x["_t"] == plan["_tie"]))
    whole = F.expr("CASE WHEN repeats > 0 THEN transform(sequence(1, repeats), i -> struct(cast(-1 as bigint) AS start, cast(0 as bigint) AS length)) ELSE array() END")
    parts = F.filter(F.concat(whole, F.array("span1", "span2")), lambda p: (p["start"] < 0) | (p["length"] > 0))
    x = x.select("_row", F.explode(parts).alias("_part"))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.slice(words, F.greatest(F.col("_part.start") + 1, F.lit(1)).cast("int"), F.col("_part.length").cast("int")), " ")
    x = x.select(F.col("_row").withField("text", F.when(F.col("_part.start") < 0, F.col("_row.text")).otherwise(cut)).alias("_row"))
    if "n_chars" in docs.columns:
        x = x.select(F.col("_row").withField("n_chars", F.length("_row.text").cast(docs.schema["n_chars"].dataType)).alias("_row"))
    return x.select("_row.*")
