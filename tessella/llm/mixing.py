"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

1.  A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources, ordered by code point with
    null last, weigh ``weights`` in turn and share ``share`` times all words; a source gets at most ``most``
    times its own words and what it can't use goes to the others by weight (water filling, solved by
    prefix sums over the sources ordered by cap per weight).
2.  Each source is cut into shards of about ``SHARD_WORDS`` words by a seeded hash of doc_id and text, and each shard,
    its documents in seeded order, into blocks of equal numbers of words, about ``BLOCK``. Shards are counted in
    bundles of ``BUNDLE``.
3.  The mix is a number of blocks. Sainte-Lague gives them to sources in proportion to their targets, a source's to its
    bundles and a bundle's to its shards in proportion to their words: always to the highest quotient
    weight / (2 * seats + 1). Only quotients that can matter are made: as many seats as every claimant holds
    in a house that is surely too small are given at once, and those up to a house surely too large are
    ranked, fewer than three for each claimant.
4.  A shard with q blocks to give and n of its own takes each block q div n times, and q mod n of them, a run
    from a seeded block on, around the end, once more. As documents lie in seeded order, a run is as random as single
    blocks, but cuts two documents only. No word is taken more than ``most`` times, rounded up, and a document
    is taken as far as its words lie in taken blocks. Blocks are numbers: no table of them is made.

Windows run over one shard or one bundle each, so a source with a third of all rows is many windows. The only windows
without a key run over the sources, one row each. Nothing is random but for seeded MD5 order: reruns agree.

Null text has size 0; null sources are one source, last. Rows with one doc_id are mixed each on its own; rows with equal
doc_id, source and text are one document in mixed_documents(), taken as often as all of them. A very long text may be a
shard of its own size. An empty table gives no rows. Clashing names of other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
SHARD_WORDS = 1 << 18
BUNDLE = 1024
BLOCK = 8
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(x.cast("string"), F.lit("")) for x in parts]))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, src, source_size, target: one row for each source of ``sizes`` (source, size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    everything = Window.partitionBy()
    turn = F.array(*[F.lit(w) for w in weights])
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("src", F.row_number().over(by_name))
        .withColumn("weight", F.get(turn, (F.col("src") - 1) % len(weights)))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(share) - F.sum("cap").over(fill) + F.col("cap"))
        .withColumn("still", F.sum("weight").over(everything) - F.sum("weight").over(fill) + F.col("weight"))
        .withColumn("level", F.max(F.col("left") / F.col("still")).over(everything))
        .select("source", "src", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))
    )


def sainte_lague(claims: DataFrame, group: list[str], claimant: str, weight: str, house: str) -> DataFrame:
    """``claims`` with a column ``seats``: ``house`` seats of each group go to its claimants by highest quotients.

    Ties go to the smaller claimant. A group without positive weight gets none.
    """
    whole = Window.partitionBy(*group)
    best = Window.partitionBy(*group).orderBy(F.col("quotient").desc(), claimant)
    total = F.sum(weight).over(whole)
    n = F.count(F.lit(1)).over(whole)
    at = lambda size: F.floor(F.col(weight) * F.greatest(size, F.lit(0)) / F.col("total") + 0.5)
    base = (
        claims.withColumn("total", total).withColumn("claimants", n)
        .withColumn("sure", F.when(F.col("total") > 0, at(F.col(house) - F.col("claimants"))).otherwise(0))
        .withColumn("likely", F.when(F.col("total") > 0, at(F.col(house) + F.col("claimants"))).otherwise(0))
        .withColumn("open", F.col(house) - F.sum("sure").over(whole))
    )
    won = (
        base.filter("likely > sure")
        .withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("likely") - 1)))
        .withColumn("quotient", F.col(weight) / (2 * F.col("k") + 1))
        .withColumn("place", F.row_number().over(best))
        .filter("place <= open")
        .groupBy(*group, claimant).agg(F.count(F.lit(1)).alias("more"))
    )
    return (
        base.join(won, [*group, claimant], "left")
        .withColumn("seats", F.col("sure") + F.coalesce("more", F.lit(0)))
        .drop("total", "claimants", "sure", "likely", "open", "more")
    )


KEY = ["src", "shard"]


def _placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size, tie) with their source's columns, their shard and the number of the shard's words before them."""
    number = F.conv(F.substring(F.col("order"), 1, 15), 16, 10).cast("long")
    ordered = Window.partitionBy(*KEY).orderBy("order", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    named = sources.withColumnRenamed("source", "its_source")
    return (
        sizes.join(named, sizes["source"].eqNullSafe(named["its_source"])).drop("its_source")
        .withColumn("order", seeded(F.col("doc_id"), F.col("tie")))
        .withColumn("shard", F.pmod(number, F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("long"))
        .withColumn("before", F.sum("size").over(ordered) - F.col("size"))
    )


def _shards(placed: DataFrame, sources: DataFrame, share: float, most: int) -> DataFrame:
    """One row for each shard: how often all of it is taken (each), and the words from, to and after that, around the end, are taken once more."""
    house = F.floor(F.sum("source_size").over(Window.partitionBy()) * F.lit(share) / BLOCK + 0.5).cast("long")
    seats = sainte_lague(sources.select("src", "target", F.lit(0).alias("all"), house.alias("house")), ["all"], "src", "target", "house")
    shards = placed.groupBy(*KEY).agg(F.sum("size").alias("words")).filter("words > 0").withColumn("bundle", F.expr(f"shard div {BUNDLE}"))
    bundles = shards.groupBy("src", "bundle").agg(F.sum("words").alias("bundle_words"))
    bundles = bundles.join(seats.select("src", F.col("seats").alias("blocks")), "src")
    bundles = sainte_lague(bundles, ["src"], "bundle", "bundle_words", "blocks").select("src", "bundle", F.col("seats").alias("blocks"))
    shards = sainte_lague(shards.join(bundles, ["src", "bundle"]), ["src", "bundle"], "shard", "words", "blocks")
    n = F.greatest(F.lit(1), F.round(F.col("words") / BLOCK)).cast("long")
    first = F.pmod(F.conv(F.substring(seeded(F.col("src"), F.col("shard"), F.lit("run")), 1, 15), 16, 10).cast("long"), F.col("n"))
    run = (
        shards.withColumn("n", n).withColumn("seats", F.least(F.col("seats"), F.col("n") * most))
        .withColumn("first", first).withColumn("last", F.expr("first + seats % n"))
    )
    at = lambda i: f"cast({i} as bigint) * words div n"
    return run.select(
        *KEY, F.expr("seats div n").alias("each"), F.expr(at("first")).alias("low"), F.expr(at("least(last, n)")).alias("high"), F.expr(at("greatest(last - n, 0)")).alias("again")
    )


def plan(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """``sizes`` (doc_id, source, size, tie) with their source's size and target, and of each document how often it is taken
    whole (each) and which of its words once more: those from ``low`` to ``high`` and those before ``again``; ``taken`` altogether."""
    if share > most:
        raise ValueError("a share above the most that each source may give can't be met")
    sources = targets(sizes.select("source", "size"), weights, share, most)
    placed = _placed(sizes, sources)
    found = placed.join(_shards(placed, sources, share, most), KEY, "left")
    inside = lambda x: F.least(F.greatest(F.coalesce(F.col(x), F.lit(0)) - F.col("before"), F.lit(0)), F.col("size"))
    found = found.withColumns({"each": F.coalesce("each", F.lit(0)), **{x: inside(x) for x in ("low", "high", "again")}})
    return found.withColumn("taken", (F.col("each") * F.col("size") + F.col("high") - F.col("low") + F.col("again")).cast("long"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie (MD5 of the text), written once: every later step reads these few bytes a document instead of its text."""
    return written(docs.select(*_keys()), "mixing")


def _keys() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("tie")]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source)."""
    return plan(sized(docs), weights, share, most).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken, each time with the words taken.

    A document whose words are all taken keeps its text; one on the edge of a run keeps the words inside
    taken blocks, each with the white space after it. Documents without words aren't part of the mix.
    Texts meet the plan once, by doc_id and MD5.
    """
    columns, key = docs.columns, ["doc_id", "source", "tie"]
    sizes = sized(docs)
    taken = plan(sizes, weights, share, most).filter("taken > 0")
    whole = F.expr("high - low + again = size")
    part = F.when(~whole & F.expr("high - low + again > 0"), F.struct("low", "high", "again"))
    taken = taken.groupBy(*key).agg(F.sum(F.col("each") + whole.cast("int")).alias("times"), F.collect_list(part).alias("parts"))
    copies = F.concat(F.array_repeat(F.lit(None).cast("struct<low: bigint, high: bigint, again: bigint>"), F.col("times").cast("int")), F.col("parts"))
    rows = docs.select(*[c.alias(f"its_{k}") for k, c in zip(("doc_id", "source", "size", "tie"), _keys(), strict=True)], F.struct(*[F.col(c) for c in columns]).alias("row"))
    if not sizes.groupBy(*key).count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["its_doc_id", "its_source", "its_tie"])
    same = [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in key]
    met = rows.join(taken, same[0] & same[1] & same[2]).select("row", F.explode(copies).alias("part"))
    # the text as white space before its first word, if any, then words with the white space after them
    words = F.split(F.col("row.text"), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("row.text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    split = met.withColumns({"lead": lead, "words": F.when(F.col("part").isNotNull(), words)})
    cut = F.expr("array_join(concat(slice(words, 1 + lead, cast(part.again as int)), slice(words, cast(part.low as int) + 1 + lead, cast(part.high - part.low as int))), '')")
    out = split.withColumn("new_text", F.when(F.col("part").isNull(), F.col("row.text")).otherwise(cut))
    fields = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return out.select(*[fields.get(c, F.col("row").getField(c)).alias(c) for c in columns])
