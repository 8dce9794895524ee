"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, free_name, n_words, perhaps, spaced, stage

#: words of a block
BLOCK = 512
#: slots whose ranks one task counts together
CHUNK = 4096
#: equal cells of the unit interval in which a slot's point looks up its source
CELLS = 4096
#: rows of a range of a source that one task numbers, about
RANGE_ROWS = 100_000
#: points of the schedule are i * STEP mod 2**31, over 2**31: multiples of the golden ratio, in whole numbers
STEP, SPAN = 1327217885, 1 << 31


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes``: source, source_size. Adds sid (0, 1, ... by code point, null last) and target (words, double).

    Weights repeat in this order. The targets share ``share`` times all sizes by weight; none is above ``most`` times its source's
    size, and what is cut off goes to the others by weight, until none is above: in the order of ``most * size / weight`` the
    first sources are full, and the rest share what these leave. One row a source, so one task orders them.
    """
    ranked = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(order), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("sid"), F.col("level").alias("level")))
    ranked = ranked.withColumn("level", F.min(fits).over(everything)["level"])
    return ranked.select("source", "source_size", "sid", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def schedule(sources: DataFrame) -> DataFrame:
    """``sources``: sid, blocks (how many slots it gets), from (all blocks of lower sids). Returns slot, sid, block.

    Slot i looks up its source at the point i * STEP mod 2**31 of the blocks' cumulative shares, and takes that source's next
    block. These points spread so evenly that a source gets its blocks but for a few; a source's surplus slots are left out and
    its missing blocks come at the end. Ranks are counted within chunks of slots and summed over chunks, so no source is
    gathered in one task.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    own = sources.where("blocks > 0")
    cell = lambda x: F.least(F.floor(x * CELLS / F.lit(max(total, 1))), F.lit(CELLS - 1))
    cells = own.select("sid", "from", "blocks", F.explode(F.sequence(cell(F.col("from")), cell(F.col("from") + F.col("blocks")))).alias("cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id % {SPAN}L * {STEP}L % {SPAN}L").alias("point"))
    slots = slots.withColumn("cell", F.expr(f"point div {SPAN // CELLS}L")).withColumn("at", F.col("point") * F.lit(total / SPAN))
    slots = slots.join(cells, "cell").where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("from") + F.col("blocks")))
    slots = slots.select("slot", "sid", "blocks", F.expr(f"slot div {CHUNK}").alias("chunk"))
    counts = slots.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1
    ranked = slots.withColumn("rank", rank).join(counts, ["sid", "chunk"]).withColumn("block", F.col("before") + F.col("rank"))
    given = slots.groupBy("sid").agg(F.count("*").alias("given"))
    short = own.join(given, "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < blocks")
    late = short.select("sid", F.explode(F.sequence(F.col("given"), F.col("blocks") - 1)).alias("block"))
    late = late.select((F.lit(total) + F.col("block") * F.lit(1 << 20) + F.col("sid")).alias("slot"), "sid", "block")
    return ranked.where("block < blocks").select("slot", "sid", "block").unionByName(late)


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables: ``rows`` and ``pieces``.

    rows: one for each row of ``docs``, with row (a hash of doc_id, source and text), doc_id, size (words; none for a null or blank text),
    sid, place (unique in the source), source_size and target. pieces: slot, sid, block, place, row, pass (0, or 1 for the second time),
    and the words word_from to word_to (end exclusive) of the row at that place. Read in the order of slot, the pieces are the mix.

    A source's documents are ordered by md5 of doc_id and laid end to end, ``most`` times over; the words of this stream are cut into
    blocks of ``block`` words, the last one ending at the target rounded to whole words. Slot and block join on (source, number).
    Sources may be null (ordered last); an unsplittable hot source doesn't exist, as prefix sums are built over ranges of md5 in
    each source, as many as keep RANGE_ROWS rows or fewer in one. Reruns agree; rows equal in doc_id, size and text are
    interchangeable. An empty table gives two empty ones.
    """
    rows = docs.select(
        row_hash().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    rows = stage(rows, "mix-sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = sources.withColumn("quota", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(F.col("quota") / block))
    sources = cut(sources.withColumn("from", F.coalesce(F.sum("blocks").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))

    digits, held = 2, rows.count() >> 8
    while held > RANGE_ROWS:
        digits, held = digits + 1, held >> 4
    rows = rows.withColumn("range", F.substring("h", 1, digits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    ranges = ranges.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "sid", "source_size", "target", "quota")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size", "row")
    rows = rows.withColumn("number", F.row_number().over(inside)).withColumn("words", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.alias("d").join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.range") == F.col("r.range")))
    rows = rows.select("row", "doc_id", "size", "sid", (F.col("n_before") + F.col("number") - 1).alias("place"), (F.col("words_before") + F.col("words")).alias("start"), "source_size", "target", "quota")
    rows = stage(rows, "mix-places")

    parts = rows.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    parts = parts.withColumn("to", F.least(F.col("at") + F.col("size"), F.col("quota"))).where("to > at")
    parts = parts.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (to - 1) div {block})")))
    parts = parts.select(
        "sid", "block", "place", "row", "size", "pass", (F.greatest(F.col("at"), F.col("block") * block) - F.col("at")).alias("word_from"), (F.least(F.col("to"), (F.col("block") + 1) * block) - F.col("at")).alias("word_to")
    )
    pieces = parts.join(schedule(sources.select("sid", "blocks", "from")), ["sid", "block"])
    return rows, pieces


def row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text"))


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), first_slot (of the schedule; null if nothing is
    taken) and n_pieces (how many blocks have words of it, repeats counted) of every row."""
    rows, pieces = mix(docs, **how)
    took = pieces.select("sid", "place", (F.col("word_to") - F.col("word_from")).alias("words"), "slot", F.lit(1).cast("long").alias("piece"))
    none = rows.select("sid", "place", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("slot"), F.lit(0).cast("long").alias("piece"))
    every = none.unionByName(took).groupBy("sid", "place").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("piece").alias("n_pieces"))
    return rows.join(every, ["sid", "place"]).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space within kept."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(acc: Column, w: Column) -> Column:
        seen = acc["seen"] + (w != "").cast("int")
        to = acc["at"] + F.char_length(w)
        return F.struct((to + 1).alias("at"), seen.alias("seen"), F.when((w != "") & (seen <= n), to).otherwise(acc["end"]).alias("end"))

    return F.substring(text, F.lit(1), F.aggregate(F.split(spaced(text), " ", -1), zero, step, lambda acc: acc["end"]))


def slot_name(columns: list[str]) -> str:
    """The column of mixed() that tells the slot: mix_slot, or a longer name if there is such a column already."""
    return free_name("mix_slot", columns)


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix has them, with slot_name(): the first slot of each document's pass in the schedule. Read in the order of this column, each
    beginning of the rows holds the sources near their target shares, wherever and however often they have been written.

    Keeps all columns of ``docs``; n_chars, if there is one, is that of the text. A document that is taken once and a half comes twice,
    the second time cut after the words taken (white space before that is kept). Documents of which nothing is taken go. Rows equal in
    doc_id, source and text stand for each other; what is taken of them all is given out whole. Texts move once, to meet the plan.
    """
    slot = slot_name(docs.columns)
    rows, pieces = mix(docs, **how)
    plan = pieces.groupBy("sid", "place", "pass").agg(F.min("row").alias("mix_row"), F.min("size").alias("mix_size"), F.min("slot").alias("slot"), F.sum(F.col("word_to") - F.col("word_from")).alias("mix_words"))
    plan = stage(plan.select("mix_row", F.struct("slot", F.col("mix_size").alias("size"), F.col("mix_words").alias("words")).alias("mix_plan")), "mix-plan")
    twice = stage(rows.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("mix_row")), "mix-equal")
    own = F.struct(*docs.columns).alias("mix_own")
    hashed = perhaps(docs.select(own, row_hash().alias("mix_row")), twice, "mix_row", keep="mix_twice")
    single = hashed.where("not mix_twice").unionByName(hashed.where("mix_twice").dropDuplicates(["mix_row"]))
    joined = single.join(plan.hint("merge"), "mix_row")
    whole = F.col("mix_own.text")
    text = F.when(F.col("mix_plan.words") == F.col("mix_plan.size"), whole).otherwise(first_words(whole, F.col("mix_plan.words").cast("int")))
    kept = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return joined.select(*[kept.get(c, F.col(f"mix_own.`{c}`")).alias(c) for c in docs.columns], F.col("mix_plan.slot").alias(slot))
