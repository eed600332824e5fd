"""Near-duplicate claims: folded copies, pairs, and per-work signals."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from works_risk.functions.cleaning import has_long_text, has_text
from works_risk.functions.vectors import EmbedMany, embedding, hashed_trigrams, norm, with_unit
from works_risk.operators.blocking import SMALL_VECTOR_ROWS, block_key, marked_blocks, shared_points, similar_items
from works_risk.operators.lookup import attach
from works_risk.operators.ordering import top_rows
from works_risk.operators.texts import KEY, TEXT, TOGETHER, beside
from works_risk.params import MIN_TEXT_CHARS, Params
from works_risk.session import dealt, scratch, settle, small_batches, spread

_SIGNALS = ["dup_partner_count", "dup_partner_sim_max", "dup_partner_cross_fy"]
#: The number of a text that shares its block with no other work.
ALONE = -1
_EDGE = ["block", "item_a", "item_b", "similarity"]


def claims(master: DataFrame, params: Params, min_chars: int = 1) -> DataFrame:
    """Works that can be compared: those with usable text.

    Returns ``work_id, block, fy, text, item``. ``item`` names the text, so copies share it. A master that carries ``text_id``
    in the place of the text gives no ``text``.
    """
    keyed = KEY in master.columns
    if keyed:
        usable = F.col(KEY) != ""
    else:
        usable = has_text(F.col("work_desc")) if min_chars <= 1 else has_long_text(F.col("work_desc"), min_chars)
    extra = [F.col("work_category")] if params.block_on_category else []
    rows = master.filter(usable)
    if params.max_texts is not None:
        rows = top_rows(rows, [F.desc_nulls_last("recommended_amount"), F.asc("work_id")], params.max_texts)
    named = rows.select(
        "work_id",
        block_key(params.amount_grain, *extra).alias("block"),
        F.coalesce("fy", F.lit("")).alias("fy"),
        F.col(KEY).alias("item") if keyed else F.trim("work_desc").alias("text"),
    )
    return named if keyed else named.withColumn("item", F.sha2("text", 256))


def folded(members: DataFrame) -> DataFrame:
    """One point per distinct text of a block: its text, number of works and lowest work id.

    Blocks of a single work are left out. Copies combine before the shuffle, and the shuffle is by block and text.
    """
    points = members.groupBy("block", "item").agg(
        *([F.any_value("text").alias("text")] if "text" in members.columns else []),
        F.count(F.lit(1)).alias("works"),
        F.min("work_id").alias("first_id"),
        F.max("work_id").alias("last_id"),
    )
    return shared_points(points)


def worded(points: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Points with their texts; those folded without get them by key, from ``texts``."""
    if texts is None:
        return points
    return beside(points, texts.withColumnsRenamed({KEY: "item", TEXT: "text"}), F.struct("block", "item"), "item")


def embedded(points: DataFrame, embed_many: EmbedMany = hashed_trigrams) -> DataFrame:
    """Points with unit vectors; a point whose vector is zero cannot match and is left out.

    Settled, because the embedder is the costly step and several branches read its result.
    """
    small_batches(points.sparkSession)
    raw = spread(points, "block", "item").withColumn("raw", embedding(F.col("text"), embed_many)).drop("text")
    return settle(with_unit(raw.filter(norm(F.col("raw")) > 0), "raw").drop("raw"))


def embedded_by_key(points: DataFrame, texts: DataFrame, models: dict[str, EmbedMany]) -> dict[str, DataFrame]:
    """As ``embedded``, by model, for points folded without their texts: what ``points`` has, ``block_rows`` and ``raw``.

    ``texts`` holds texts by key. Each that a point names is moved once and embedded once by each model, beside the list of its
    points, and only its vectors go on. A text of more than ``TOGETHER`` points is left out there and its vectors are broadcast.
    """
    spark = points.sparkSession
    small_batches(spark)
    marked = settle(marked_blocks(points, SMALL_VECTOR_ROWS))
    # Each listed text has more than TOGETHER points, so the list is short beside the points.
    many = settle(marked.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TOGETHER).select("item"))
    raw = [embedding(F.col(TEXT), model).alias(name) for name, model in models.items()]
    place = F.struct(*[c for c in marked.columns if c != "item"])
    named = texts.select(F.col(KEY).alias("item"), TEXT)
    once = dealt(named, "item").dropDuplicates(["item", TEXT])
    places = marked.join(F.broadcast(many), "item", "left_anti").groupBy("item").agg(F.collect_list(place).alias("places"))
    listed = once.join(places, "item").select("item", "places", *raw)
    found = listed.select("item", F.explode("places").alias("place"), *models).select("item", "place.*", *models)
    if not many.isEmpty():
        some = named.join(F.broadcast(many), "item").dropDuplicates(["item", TEXT])
        found = found.unionByName(marked.join(F.broadcast(settle(some.select("item", *raw))), "item"))
    path = scratch(spark, "vectors")
    found.write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    return {name: found.filter(norm(F.col(name)) > 0).select(*marked.columns, F.col(name).alias("raw")) for name in models}


def text_links(points: DataFrame, threshold: float) -> DataFrame:
    """Matches between folded points, each unordered pair of texts once, and each text with itself for its copies."""
    own = points.select("block", F.col("item").alias("item_a"), F.col("item").alias("item_b"), F.lit(1.0).alias("similarity"))
    return similar_items(points, threshold).select(*_EDGE).unionByName(own)


def both_ways(links: DataFrame) -> DataFrame:
    """Every link from both of its ends; a text's link with itself once."""
    there = F.struct(F.col("item_a").alias("item_a"), F.col("item_b").alias("item_b"))
    back = F.struct(F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"))
    ends = F.explode(F.when(F.col("item_a") == F.col("item_b"), F.array(there)).otherwise(F.array(there, back))).alias("e")
    rest = [c for c in links.columns if c not in ("item_a", "item_b")]
    return links.select(ends, *rest).select("e.*", *rest)


def edges(points: DataFrame, threshold: float) -> DataFrame:
    """Matches between folded points in both directions, plus each point with itself (its copies)."""
    return both_ways(text_links(points, threshold))


def folded_signals(members: DataFrame, links: DataFrame) -> DataFrame:
    """Signals per work from links between folded points, without writing out pairs of works.

    Works of one text and year share their signals, so the counts are taken per (text, year): all works behind the
    linked texts, less the work itself, and of those the ones in another year.
    """
    per_year = members.groupBy("block", "item", "fy").agg(F.count(F.lit(1)).alias("works"))
    linked = links.join(per_year.withColumnRenamed("item", "item_b"), ["block", "item_b"])
    by_year = linked.groupBy("block", F.col("item_a").alias("item"), "fy").agg(
        F.sum("works").alias("in_year"),
        F.max(F.when(F.col("item_a") != F.col("item_b"), F.col("similarity"))).alias("sim_in_year"),
        F.sum(F.when(F.col("item_a") == F.col("item_b"), F.col("works"))).alias("own"),
    )
    whole = by_year.groupBy("block", "item").agg(
        F.sum("in_year").alias("all_works"),
        F.sum("own").alias("all_own"),
        F.max("sim_in_year").alias("sim_max"),
    )
    shared = by_year.select("block", "item", "fy", "in_year", "own").join(whole, ["block", "item"])
    partners = F.col("all_works") - 1
    best = F.when(F.col("all_own") > 1, F.lit(1.0)).otherwise(F.col("sim_max"))
    key = F.concat_ws("|", "block", "item", "fy")
    per_text = shared.filter(partners > 0).select(
        key.alias("_text"),
        partners.alias("dup_partner_count"),
        best.alias("dup_partner_sim_max"),
        (F.col("all_works") - F.col("in_year")).alias("dup_partner_cross_fy"),
        F.coalesce("own", F.lit(1)).alias("n"),
    )
    # All copies of one text ask for one row, so that key may hold any share of the works.
    found = attach(members.select("work_id", key.alias("_text")), settle(per_text), "_text", F.col("work_id"))
    return found.filter(F.col("dup_partner_count").isNotNull()).drop("_text")


def lead(params: Params) -> Column:
    counted = "dup_partner_cross_fy" if params.cross_year_only else "dup_partner_count"
    return F.col(counted) > 0


def zero_filled(works: DataFrame, signals: DataFrame, params: Params) -> DataFrame:
    """Signals for every work of ``works``; a work without partners has zeros."""
    return (
        works.select("work_id")
        .join(signals, "work_id", "left")
        .fillna(0, subset=["dup_partner_count", "dup_partner_cross_fy"])
        .fillna(0.0, subset=["dup_partner_sim_max"])
        .withColumn("has_duplicate_lead", lead(params))
    )


def no_signals(works: DataFrame) -> DataFrame:
    return works.select(
        "work_id",
        F.lit(0).cast("bigint").alias("dup_partner_count"),
        F.lit(0.0).alias("dup_partner_sim_max"),
        F.lit(0).cast("bigint").alias("dup_partner_cross_fy"),
        F.lit(False).alias("has_duplicate_lead"),
    )


def duplicate_signals(
    master: DataFrame, params: Params, embed_many: EmbedMany = hashed_trigrams, texts: DataFrame | None = None, once: bool = False
) -> DataFrame:
    """Embed, compare inside blocks and count partners, for every work of ``master``. ``texts`` has the descriptions of a master
    that carries their keys; with ``once`` each is embedded once, else each block embeds its own."""
    members = claims(master, params)
    points = folded(members)
    vectors = embedded_by_key(points, texts, {"own": embed_many})["own"] if once else embedded(worded(points, texts), embed_many)
    links = edges(vectors, params.duplicate_cosine)
    return zero_filled(master, folded_signals(members, links), params)


def _claim_states(master: DataFrame, params: Params) -> DataFrame:
    """``work_id, block, state`` of each work: all that its signals and those of its block depend on."""
    extra = [F.col("work_category")] if params.block_on_category else []
    text = F.nullif(KEY, F.lit("")) if KEY in master.columns else F.when(has_text(F.col("work_desc")), F.trim("work_desc"))
    return master.select(
        "work_id", block_key(params.amount_grain, *extra).alias("block"), F.xxhash64(F.coalesce("fy", F.lit("")), text, text.isNull()).alias("state")
    )


def in_touched_blocks(master: DataFrame, earlier: DataFrame, params: Params) -> DataFrame:
    """The works of ``master`` in whose block a work came, went or changed its block, year or text since ``earlier``."""
    new, old = _claim_states(master, params), _claim_states(earlier, params)
    both = new.join(old.toDF("_id", "_block", "_state"), F.col("work_id") == F.col("_id"), "full")
    same = F.col("block").eqNullSafe(F.col("_block")) & F.col("state").eqNullSafe(F.col("_state")) & F.col("_id").isNotNull() & F.col("work_id").isNotNull()
    touched = both.filter(~same).select(F.explode(F.array("block", "_block")).alias("block")).filter(F.col("block").isNotNull()).distinct()
    sizes = new.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    marked = settle(sizes.join(touched.withColumn("touched", F.lit(True)), "block", "left"))
    keyed = master.join(new.select("work_id", "block"), "work_id")
    found = attach(keyed, marked, "block", F.xxhash64("work_id"))
    return found.filter("touched").drop("block", "touched")


def updated_signals(
    master: DataFrame,
    earlier: DataFrame,
    earlier_signals: DataFrame,
    params: Params,
    embed_many: EmbedMany = hashed_trigrams,
    texts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Signals of ``master`` given those of an earlier master, and the works whose blocks were compared again.

    Blocks in which nothing changed keep their signals; no text of theirs is embedded. The result equals ``duplicate_signals``.
    """
    if params.max_texts is not None:
        raise ValueError("a bound on texts depends on all works, so nothing can be kept")
    again = settle(in_touched_blocks(master, earlier, params))
    members = claims(again, params)
    links = edges(embedded(worded(folded(members), texts), embed_many), params.duplicate_cosine)
    ids = again.select("work_id")
    kept = earlier_signals.join(ids, "work_id", "left_anti").select("work_id", *_SIGNALS)
    found = kept.unionByName(folded_signals(members, links).select("work_id", *_SIGNALS))
    return zero_filled(master, found, params), ids


def with_copies(members: DataFrame, links: DataFrame) -> DataFrame:
    """Write links between folded points, in both directions, out as pairs of works, ``work_a < work_b``.

    The result has one row per pair of works, so it is as large as the answer; signals and counts do not need it.
    Further columns of ``links`` come along.
    """
    a = members.select("block", F.col("item").alias("item_a"), F.col("work_id").alias("work_a"))
    b = members.select("block", F.col("item").alias("item_b"), F.col("work_id").alias("work_b"))
    rest = [c for c in links.columns if c not in ("block", "item_a", "item_b")]
    return (
        links.join(a, ["block", "item_a"])
        .join(b, ["block", "item_b"])
        .filter(F.col("work_a") < F.col("work_b"))
        .select("work_a", "work_b", *rest)
    )


def pair_table(master: DataFrame, params: Params, embed_many: EmbedMany = hashed_trigrams) -> DataFrame:
    members = claims(master, params)
    return with_copies(members, edges(embedded(folded(members), embed_many), params.duplicate_cosine))


@dataclass(frozen=True)
class Sweep:
    """What a sweep stores: works with the number of the text they name, and links between texts for each model.

    ``works``: work_id, block, item, fy. ``links``: model, block, item_a, item_b, similarity, each unordered pair of texts once
    and every text that can match with itself. N copies of a text are N rows here, not N squared.
    """

    works: DataFrame
    links: DataFrame

    def of(self, model: str) -> DataFrame:
        return self.links.filter(F.col("model") == model).drop("model")


def sweep_texts(
    master: DataFrame, models: dict[str, EmbedMany], params: Params, exact: bool = True, texts: DataFrame | None = None
) -> Sweep:
    """Sweep the works with long enough text with several embedders, in blocks of exact amounts or those of ``params``.

    ``texts`` has the descriptions of a master that carries their keys, of long enough ones only.
    """
    members = claims(master, replace(params, amount_grain=0) if exact else params, MIN_TEXT_CHARS)
    # Links may be far more than texts, so they hold short numbers of the texts.
    points = settle(folded(members).withColumn("number", F.monotonically_increasing_id()))
    vectors = {name: embedded(points, model) for name, model in models.items()} if texts is None else embedded_by_key(points, texts, models)
    numbered = {name: found.drop("item").withColumnRenamed("number", "item") for name, found in vectors.items()}
    tables = [text_links(numbered[name], params.duplicate_cosine).withColumn("model", F.lit(name)) for name in models]
    works = members.select("work_id", "block", "item", "fy").join(points.select("block", "item", "number"), ["block", "item"], "left")
    return Sweep(works.select("work_id", "block", F.coalesce("number", F.lit(ALONE)).alias("item"), "fy"), reduce(DataFrame.unionByName, tables))


def signals_from_links(found: Sweep, model: str, master: DataFrame, params: Params) -> DataFrame:
    """Signals for every work of ``master`` from a stored sweep, without writing out pairs of works."""
    return zero_filled(master, folded_signals(found.works, both_ways(found.of(model))), params)


def work_pairs(found: Sweep, master: DataFrame) -> DataFrame:
    """The sweep as pairs of works with the status of both: as large as the answer, for export."""
    # Works get their status before they meet the links, of which there may be far more.
    known = found.works.select("work_id", "block", "item").join(master.select("work_id", "work_status", "mp_name"), "work_id", "left")
    end = F.struct(F.col("work_id").alias("work"), F.col("work_status").alias("status"), F.col("mp_name").alias("mp"))
    a = known.select("block", F.col("item").alias("item_a"), end.alias("a"))
    b = known.select("block", F.col("item").alias("item_b"), end.alias("b"))
    met = found.links.join(a, ["block", "item_a"]).join(b, ["block", "item_b"])
    # Copies of one text meet both ways, works of two texts once.
    turned = F.col("a.work") > F.col("b.work")
    kept = met.filter((F.col("a.work") < F.col("b.work")) | (turned & (F.col("item_a") != F.col("item_b"))))
    first, second = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    ends = kept.select("model", F.round("similarity", 4).alias("similarity"), first.alias("a"), second.alias("b"))
    return ends.select(
        "model", "similarity", F.col("a.work").alias("work_a"), F.col("b.work").alias("work_b"),
        F.col("a.status").alias("work_status_a"), F.col("b.status").alias("work_status_b"), F.col("a.mp").alias("mp_name"),
    )


def link_counts(found: Sweep) -> DataFrame:
    """``model, pairs, texts``: pairs of works and linked pairs of different texts, counted from the links and the number of
    works behind each text."""
    spark = found.works.sparkSession
    path = scratch(spark, "copies")
    # Most texts have one work. The others are written, so that Spark knows how small the list is and need not move the links.
    found.works.groupBy("block", "item").agg(F.count(F.lit(1)).alias("works")).filter(F.col("works") > 1).write.parquet(path)
    copies = spark.read.parquet(path)
    a = copies.select("block", F.col("item").alias("item_a"), F.col("works").alias("works_a"))
    b = copies.select("block", F.col("item").alias("item_b"), F.col("works").alias("works_b"))
    own = F.col("item_a") == F.col("item_b")
    n_a, n_b = F.coalesce("works_a", F.lit(1)), F.coalesce("works_b", F.lit(1))
    pairs = F.when(own, n_a * (n_a - 1) / 2).otherwise(n_a * n_b)
    met = found.links.join(a, ["block", "item_a"], "left").join(b, ["block", "item_b"], "left")
    return met.groupBy("model").agg(F.sum(pairs.cast("bigint")).alias("pairs"), F.count_if(~own).alias("texts"))


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Unordered pairs once each, with their highest similarity."""
    return pairs.groupBy(
        F.least("work_a", "work_b").alias("work_a"), F.greatest("work_a", "work_b").alias("work_b")
    ).agg(F.max("similarity").alias("similarity"))


def mirrored_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once per end; the pair table is read once."""
    ends = F.array(
        F.struct(F.col("work_a").alias("work_id"), F.col("work_b").alias("partner")),
        F.struct(F.col("work_b").alias("work_id"), F.col("work_a").alias("partner")),
    )
    rest = [c for c in pairs.columns if c not in ("work_a", "work_b")]
    return pairs.select(F.explode(ends).alias("e"), *rest).select("e.*", *rest)


def with_years(pairs: DataFrame, master: DataFrame) -> DataFrame:
    """Fiscal year of both ends, and whether they differ; an end that is not in ``master`` counts as different."""
    a = master.select(F.col("work_id").alias("work_a"), F.col("fy").alias("fy_a"))
    b = master.select(F.col("work_id").alias("work_b"), F.col("fy").alias("fy_b"))
    cross = F.coalesce("fy_a", F.lit("")) != F.coalesce("fy_b", F.lit(""))
    return pairs.join(a, "work_a", "left").join(b, "work_b", "left").withColumn("cross_fy", cross)


def signals_from_pairs(pairs: DataFrame, master: DataFrame, params: Params) -> DataFrame:
    """Signals for every work of ``master`` from a ready pair table."""
    per_work = (
        mirrored_pairs(with_years(pairs, master).select("work_a", "work_b", "similarity", "cross_fy"))
        .groupBy("work_id")
        .agg(
            F.count(F.lit(1)).alias("dup_partner_count"),
            F.max("similarity").alias("dup_partner_sim_max"),
            F.count_if("cross_fy").alias("dup_partner_cross_fy"),
        )
    )
    return zero_filled(master, per_work, params)


def signals_from_sweep(sweep: DataFrame, model: str, master: DataFrame, params: Params) -> DataFrame:
    return signals_from_pairs(sweep.filter(F.col("model") == model), master, params)


def sweep(master: DataFrame, models: dict[str, EmbedMany], params: Params) -> DataFrame:
    """Pairs of works of several embedders over exact-amount blocks of works with long enough text."""
    return work_pairs(sweep_texts(master, models, params), master)


def exclusive_pairs(sweep_table: DataFrame, model: str, other: str) -> DataFrame:
    """Unordered pairs that ``model`` found and ``other`` did not."""
    mine = canonical_pairs(sweep_table.filter(F.col("model") == model))
    theirs = canonical_pairs(sweep_table.filter(F.col("model") == other))
    return mine.join(theirs, ["work_a", "work_b"], "left_anti")


def pairs_per_model(sweep_table: DataFrame) -> DataFrame:
    return sweep_table.groupBy("model").agg(F.count(F.lit(1)).alias("pairs"))


def top_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    return top_rows(pairs, [F.desc("similarity"), F.asc("work_a"), F.asc("work_b")], n)


def group_stats(rows: DataFrame) -> DataFrame:
    """Number of blocks, of blocks that can hold a pair, rows in those, and the largest block."""
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    shared = F.col("n") >= 2
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(shared).alias("shared_groups"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("rows_in_shared_groups"),
        F.max("n").alias("largest_group"),
    )
