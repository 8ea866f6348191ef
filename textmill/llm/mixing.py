"""Mixing sources to target weights: packed blocks, multinomial shard counts, per-source index permutations.

Only DataFrame functions are used. Words of a source are laid out one document after the other and cut into
blocks of a fixed length. A source's target becomes a number of block draws (its quota). Each slot of an output
shard draws its source with probability quota by slots, so a shard's source counts are a multinomial draw. The
slots of a source are numbered from shard to shard; those beyond its quota, a few at the end, are given to the
sources that were drawn too seldom, so that totals meet the quotas. Slot k of a source takes block perm(k mod n)
of pass k div n, perm being a keyed permutation of the source's n block numbers of that pass, and slots and
blocks are joined by that number.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of
size 0 are kept and take nothing; repeated rows are separate documents; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import WORD, stage_table

#: Words in a block, blocks in an output shard.
BLOCK, SHARD = 64, 1024
WEIGHTS = (5, 2, 1)
CAP = 3
#: Words of a chunk, for which a source's running totals are made at once; shards whose slots are numbered at once.
CHUNK_WORDS, NUMBERED = 1 << 20, 16
#: Cells that the slots' draws are looked up by; sources up to which the table of cells is broadcast; slots of a task.
CELLS, SOURCES, TASK_SLOTS = 4096, 1024, 1 << 20


def permute(x: Column, n: Column, key: Column, rounds: int = 12) -> Column:
    """A keyed permutation of 0..n-1 (swap-or-not): each round maps x to itself or to its mirror k - x mod n."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        swap = F.xxhash64(key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), step)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey (the source, null told apart from any string), size (words) and th, a hash of the text; written once, as counting words is most of the work."""
    text = F.coalesce("text", F.lit(""))
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return docs.select("doc_id", "source", skey.alias("skey"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("th"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per source: source_size, target, blocks (n), quota (block draws), first (its first place among all quotas) and slots (all quotas).

    Targets fill by weight up to cap times the source's size: with sources by rising cap/weight, the first of
    which the cap exceeds the level left for it and all after it get level times weight.
    """
    s = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy((F.col("skey") == "n").asc(), "skey")) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("room", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("room") / F.col("w"))
    by = Window.orderBy("ratio", "skey")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum("room").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left_w = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (total - before) / left_w)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    s = s.withColumn("target", F.least("room", F.coalesce(level, F.lit(float("inf"))) * F.col("w")))
    s = s.withColumn("n", F.ceil(F.col("source_size") / block).cast("long"))
    want = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n") / F.col("source_size"))).otherwise(0).cast("long")
    s = s.withColumn("quota", F.least(want, F.floor(F.lit(cap) * F.col("n")).cast("long")))
    run = F.sum("quota").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("first", F.coalesce(run, F.lit(0))).select("skey", "source_size", "target", "n", "quota", "first", F.sum("quota").over(Window.partitionBy()).alias("slots"))


@dataclass
class Plan:
    """The sources' targets, and how many words, slots and sources there are."""

    targets: DataFrame
    words: int
    slots: int
    sources: int


def planned(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK) -> Plan:
    targets = stage_table(source_targets(sizes, weights, cap, block), "mixing")
    words, slots, sources = targets.agg(F.sum("source_size"), F.max("slots"), F.count("*")).first()
    return Plan(targets, words or 0, slots or 0, sources)


def drawn(plan: Plan, seed: int) -> DataFrame:
    """One row per slot: place (its number over all shards), skey, quota and n (blocks) of the source that it draws.

    A draw is a number below slots; the sources' quotas, one after the other, are its ranges. Ranges are found by
    cells of equal width, of which each source has those that its range touches.
    """
    slots = max(1, plan.slots)
    cells = max(1, min(slots, max(CELLS, slots // TASK_SLOTS)))
    last = F.col("first") + F.col("quota") - 1
    t = plan.targets.where("quota > 0").select("skey", "quota", "n", "first", F.explode(F.expr(f"sequence(first * {cells} div {slots}, (first + quota - 1) * {cells} div {slots})")).alias("cell"), last.alias("last"))
    t = F.broadcast(t) if plan.sources <= SOURCES else t.hint("merge")  # at most CELLS rows more than sources
    spark = plan.targets.sparkSession
    tasks = max(1, min(plan.slots // (TASK_SLOTS // 16), int(spark.conf.get("spark.sql.shuffle.partitions"))), plan.slots // TASK_SLOTS)
    s = spark.range(0, plan.slots, 1, tasks).select(F.col("id").alias("place"), F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(slots)).alias("u"))
    s = s.withColumn("cell", F.expr(f"u * {cells} div {slots}"))
    return s.join(t, "cell").where("u BETWEEN first AND last").select("place", "skey", "quota", "n")


def draws(plan: Plan, seed: int = 17, shard: int = SHARD) -> DataFrame:
    """One row per output slot: place, skey and idx, the block that it takes.

    Counts, slots and the few that change their source are written one after the other: as one plan, with what is
    joined to it, they keep too many stages in the driver's memory at once.
    """
    idx = permute(F.expr("k % n"), F.col("n"), F.xxhash64(F.lit(seed), "skey", F.expr("k div n")))
    d = drawn(plan, seed).withColumn("part", F.expr(f"place div {NUMBERED * shard}"))
    counts = stage_table(d.groupBy("skey", "part").agg(F.count("*").alias("m")), "mixing")
    before = F.sum("m").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("skey", "part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("skey", "part").orderBy("place")) - 1
    d = d.withColumn("own", own).join(first.hint("merge"), ["skey", "part"]).withColumn("k", F.col("own") + F.col("before"))
    d = stage_table(d.select("place", "skey", F.when(F.col("k") < F.col("quota"), idx).alias("idx")), "mixing")
    # Slots beyond a source's quota, about the root of all slots: they take, in order, the draws that other sources lack.
    total = counts.groupBy("skey").agg(F.sum("m").alias("m"))
    lacking = plan.targets.where("quota > 0").join(total, "skey", "left").withColumn("m", F.coalesce("m", F.lit(0))).where("m < quota")
    lacking = lacking.select("skey", "n", F.explode(F.expr("sequence(m, quota - 1)")).alias("k")).withColumn("turn", F.row_number().over(Window.orderBy("skey", "k")))
    over = d.where("idx IS NULL").select("place", F.row_number().over(Window.orderBy("place")).alias("turn"))
    moved = stage_table(over.join(lacking, "turn").select("place", "skey", idx.alias("idx")), "mixing")
    return d.where("idx IS NOT NULL").union(moved)


def laid_out(sizes: DataFrame, words: int) -> DataFrame:
    """Documents with words, and off: the words of the source before each. Each source is dealt over as many chunks as all words need, so no task holds a source."""
    chunks = max(1, -(-words // CHUNK_WORDS))
    d = sizes.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(chunks)))
    sums = d.groupBy("skey", "chunk").agg(F.sum("size").alias("s"))
    run = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "chunk", F.coalesce(F.sum("s").over(run), F.lit(0)).alias("base"))
    inner = Window.partitionBy("skey", "chunk").orderBy("doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("off", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return d.join(sums.hint("merge"), ["skey", "chunk"]).withColumn("off", F.col("off") + F.col("base")).drop("base", "chunk")


def pieces(laid: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block it reaches into: idx, lo and hi (words of the document, hi not included)."""
    p = laid.withColumn("idx", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    return p.withColumns({"lo": F.greatest(F.col("idx") * block - F.col("off"), F.lit(0)), "hi": F.least((F.col("idx") + 1) * block - F.col("off"), F.col("size"))})


def mix_documents(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    s = stage_table(sized(docs.select("doc_id", "text", "source")), "mixing")
    plan = planned(s, weights, cap, block)
    used = draws(plan, seed).groupBy("skey", "idx").agg(F.count("*").alias("uses"))
    laid = laid_out(s, plan.words)
    # Spark knows no sizes of draws and pieces, many rows made from few; none of them is to be broadcast.
    cut = pieces(laid, block).select("skey", "idx", "doc_id", "source", "size", "off", (F.col("hi") - F.col("lo")).alias("words"))
    took = cut.join(used.hint("merge"), ["skey", "idx"], "left").groupBy("skey", "off", "doc_id", "source", "size").agg(F.coalesce(F.sum(F.col("words") * F.col("uses")), F.lit(0)).alias("taken"))
    none = s.where("size = 0").select("skey", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    of = plan.targets.select("skey", "source_size", "target")
    out = took.drop("off").unionByName(none).join(F.broadcast(of) if plan.sources <= SOURCES else of.hint("merge"), "skey")
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_blocks(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """The mix itself, one row per output slot: shard, slot, source, block (number in its source), n_words, doc_ids, text.

    text has the words of the block, documents parted by a line break, the words of one by a space.
    """
    docs = docs.select("doc_id", "text", "source")
    s = stage_table(sized(docs), "mixing")
    plan = planned(s, weights, cap, block)
    # Texts meet the places of their documents once these are known: no window sorts texts. Rows equal in all are one text in several places.
    key = ["doc_id", "th", "skey"]
    places = stage_table(laid_out(s, plan.words).groupBy(*key).agg(F.any_value("size").alias("size"), F.collect_list("off").alias("offs")), "mixing")
    texts = docs.withColumns({"th": F.xxhash64("text"), "skey": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))}).where("text IS NOT NULL")
    on = [F.col("t.doc_id").eqNullSafe(F.col("p.doc_id")), F.col("t.th") == F.col("p.th"), F.col("t.skey") == F.col("p.skey")]
    found = texts.dropDuplicates(key).alias("t").join(places.hint("merge").alias("p"), on).select("p.*", "t.source", F.regexp_extract_all("t.text", F.lit(WORD), F.lit(0)).alias("words"))
    cut = pieces(found.withColumn("off", F.explode("offs")).drop("offs"), block)
    own = F.array_join(F.slice("words", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    cut = cut.select("skey", "source", "idx", "off", "doc_id", (F.col("hi") - F.col("lo")).alias("m"), own.alias("part"))
    blocks = cut.groupBy("skey", "idx").agg(F.first("source").alias("source"), F.sum("m").alias("n_words"), F.sort_array(F.collect_list(F.struct("off", "doc_id", "part"))).alias("parts"))
    out = blocks.join(draws(plan, seed, shard).hint("merge"), ["skey", "idx"])
    return out.select(
        F.expr(f"place div {shard}").alias("shard"), F.expr(f"place % {shard}").alias("slot"), "source", F.col("idx").alias("block"), "n_words",
        F.col("parts.doc_id").alias("doc_ids"), F.array_join("parts.part", "\n").alias("text"),
    )


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")
