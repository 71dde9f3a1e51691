"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Each source's documents are put in a shuffled order, by a hash of their id, end to end on a line of words, and the line
is cut into equal blocks. The mix is a list of slots; slot i has the i-th point of a golden-ratio sequence, which is
mapped through the cumulative weights to a source. Slots are ranked within their source, and the slot of rank r takes
block r modulo the source's number of blocks. What a document gives is what the taken blocks hold of it, each as often
as it is taken.

Targets: the weights repeat over the sources in code-point order, null last; the mix has `share` times all words; no
target is above `most` times its source's words, and the excess is reshared by weight.

Nothing is ordered in one task but tables of a row per source; the running sums over a line are taken in three levels,
inside buckets of the hash, over the buckets of a range of buckets, and over those ranges. Rows of one source differ in
bucket and block, so a source of many rows is spread as well. The hash is of id and text, so that rows without an id or
with one id are spread too.

Defined results: null texts have no words; texts of any length are counted whole; documents without words take nothing;
rows that tie on id and text are interchangeable; null sources are one source; repeated rows each have their place; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import fresh_name, materialise

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Blocks that a source of many words is cut into, about; documents that a bucket of the hash holds, about.
BLOCKS, BUCKET = 4096, 128
#: Buckets whose sums one task orders.
RANGE = 1 << 14
#: Golden ratio as a fraction of 2^31: point i of the sequence is i * STEP modulo CYCLE.
STEP, CYCLE = 1327217885, 1 << 31
WORDS = r"[^\x20\x09-\x0D]+"
SEED = "mix-1/"


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: dict[str, Column]) -> DataFrame:
    """A narrow row for each document: id, size, place (a hash that orders it), src (never null) and what `keep` names."""
    return materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("/"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary")).alias("place"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
            *[c.alias(n) for n, c in keep.items()],
        )
    )


def _weight(rank: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, blocks: int = BLOCKS) -> DataFrame:
    """A row for each source: src, source_size, target, block (words of a block), n_blocks, slots, low (slots of the sources before)."""
    by_code = Window.orderBy(F.col("src") == "", "src")
    whole = Window.partitionBy()
    rows = sized.groupBy("src").agg(F.sum("size").alias("source_size")).withColumn("nth", F.row_number().over(by_code) - 1)
    rows = rows.withColumns({"weight": _weight(F.col("nth"), weights).cast("double"), "all": F.sum("source_size").over(whole) * F.lit(share)})
    # In order of how soon a source is full, it is full if its share of what the fuller ones leave is above its bound.
    soonest = Window.orderBy(F.col("source_size") / F.col("weight"), "nth")
    bound = F.col("source_size") * F.lit(float(most))
    rows = rows.withColumn("bound", bound).withColumns(
        {
            "left": F.col("all") - F.coalesce(F.sum("bound").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights": F.sum("weight").over(soonest.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("full", F.col("left") * F.col("weight") >= F.col("bound") * F.col("weights"))
    free = F.when(F.col("full"), 0.0)
    rows = rows.withColumns(
        {
            "left": F.col("all") - F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0.0)).over(whole),
            "weights": F.sum(free.otherwise(F.col("weight"))).over(whole),
        }
    )
    rows = rows.withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(F.col("left") * F.col("weight") / F.col("weights")))
    rows = rows.withColumn("block", F.greatest(F.lit(1), F.floor(F.col("source_size") / blocks)).cast("long"))
    rows = rows.withColumns(
        {"n_blocks": F.ceil(F.col("source_size") / F.col("block")).cast("long"), "slots": F.floor(F.col("target") / F.col("block") + 0.5).cast("long")}
    )
    before = by_code.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0)).cast("long")).select(
        "src", "source_size", "target", "block", "n_blocks", "slots", "low"
    )


def schedule(sources: DataFrame, most: int = MOST) -> DataFrame:
    """The mix as slots: slot, src, rank, block_no, epoch; slots beyond `most` epochs of a source are left out."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    # Every whole number below the total belongs to one source; together they are the cumulative weights.
    owners = sources.where("slots > 0").select("src", "n_blocks", F.explode(F.expr("sequence(low, low + slots - 1)")).alias("point"))
    point = F.expr(f"cast(slot % {CYCLE} * {STEP} % {CYCLE} as decimal(10, 0)) * cast({total} as decimal(20, 0)) div {CYCLE}")
    slots = sources.sparkSession.range(total).select(F.col("id").alias("slot")).withColumn("point", point)
    ranked = slots.join(owners, "point").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("slot")).cast("long") - 1)
    return ranked.select(
        "slot", "src", "rank", (F.col("rank") % F.col("n_blocks")).alias("block_no"), F.expr("rank div n_blocks").alias("epoch")
    ).where(F.col("epoch") < most)


def _lines(sized: DataFrame, bucket: int) -> DataFrame:
    """Documents with words, with `at`, the words before each on its source's line."""
    n = max(1, -(-sized.count() // bucket))
    rows = sized.where("size > 0").withColumn("bucket", F.expr(f"cast(conv(substring(place, 1, 7), 16, 10) as long) * {n} div {1 << 28}"))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("range", F.expr(f"bucket div {RANGE}"))
    earlier = Window.partitionBy("src", "range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    wider = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy("src", "range").agg(F.sum("words").alias("words")).select("src", "range", F.coalesce(F.sum("words").over(wider), F.lit(0)).alias("before"))
    sums = sums.withColumn("own", F.coalesce(F.sum("words").over(earlier), F.lit(0))).join(ranges, ["src", "range"]).select("src", "bucket", (F.col("before") + F.col("own")).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(sums, ["src", "bucket"]).withColumn("at", F.col("base") + F.col("inner")).drop("base", "inner", "bucket", "place")


def _given(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: dict[str, Column], **args) -> DataFrame:
    """id, size, kept columns, source_size, target, taken, copies (how often the block with the first word is taken)."""
    sized = _prepared(docs, id_col, text_col, source_col, keep)
    sources = materialise(source_targets(sized, **args))
    taken = schedule(sources, args.get("most", MOST)).groupBy("src", "block_no").agg(F.count("*").alias("uses"))
    # A row for each document and block that holds some of it.
    lines = _lines(sized, BUCKET).join(sources.select("src", "source_size", "target", "block"), "src")
    parts = lines.withColumn("block_no", F.explode(F.expr("sequence(at div block, (at + size - 1) div block)"))).join(taken, ["src", "block_no"], "left")
    words = F.expr("least(at + size, (block_no + 1) * block) - greatest(at, block_no * block)") * F.coalesce("uses", F.lit(0))
    first = F.when(F.expr("block_no = at div block"), F.coalesce("uses", F.lit(0))).otherwise(0)
    some = parts.groupBy("src", "at", "id", "size", "source_size", "target", *keep).agg(F.sum(words).alias("taken"), F.sum(first).alias("copies"))
    none = sized.where("size = 0").join(sources.select("src", "source_size", "target"), "src")
    columns = ["id", "size", *keep, "source_size", "target", "taken", "copies"]
    return some.select(columns).unionByName(none.withColumns({"taken": F.lit(0).cast("long"), "copies": F.lit(0).cast("long")}).select(columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **args) -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    return _given(docs, id_col, text_col, source_col, {}, **args).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **args) -> DataFrame:
    """The mix as whole documents: each row as often as the block that holds its first word is taken."""
    key, copies, same = (fresh_name(docs, n) for n in ("row_key_", "copies_", "same_id_"))
    row_key = F.xxhash64(*docs.columns)
    # Rows equal in all columns are one row here, with the sum of their copies.
    given = _given(docs, id_col, text_col, source_col, {"row_key": row_key}, **args).groupBy("id", "row_key").agg(F.sum("copies").alias(copies))
    given = given.where(F.col(copies) > 0).select(F.col("id").alias(same), F.col("row_key").alias(key), copies)
    rows = docs.withColumn(key, row_key).dropDuplicates([id_col, key]).alias("d")
    right = given.withColumnRenamed(key, key + "r")
    out = rows.join(right, F.col(f"d.{id_col}").eqNullSafe(F.col(same)) & (F.col(key) == F.col(key + "r")))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select([F.col(f"d.{c}") for c in docs.columns])
