"""Exact deduplication by deterministic block naming.

A normalised text is cut into fixed-size blocks. Sorting the blocks gives each distinct block an integer name;
adjacent names are paired, the pairs are sorted and named in the same way, and so on until every document has one
name. No hash decides: two documents end with the same (level, name) exactly if their texts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skymill.llm.tables import row_key, text_of, without_rows
from skymill.runtime import cut

BLOCK = 4096  # characters
PER_BUCKET = 2_000  # blocks sorted together, about
HOT_SHARE = 1 / 1000  # blocks with at least this share of all blocks are named apart: at most 1,000 of them
WHITE = r"[\x20\x09-\x0D]+"


def without_white(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def _blocks(norm: Column, size: int) -> Column:
    """Array of (pos, block); an empty text has one empty block."""
    n = F.greatest(F.lit(1), F.ceil(F.length(norm) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("pos"), F.substring(norm, i * size + 1, F.lit(size)).alias("block")))


def _sorted_names(rows: DataFrame, value: list[str], buckets: int) -> DataFrame:
    """Adds ``name``: bucket of the value in the high bits, rank of the value among the bucket's sorted values below."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*value), F.lit(buckets)))
    order = Window.partitionBy("_bucket").orderBy(*value)
    return rows.withColumn("name", F.shiftleft(F.col("_bucket"), 32).bitwiseOR(F.dense_rank().over(order).cast("long"))).drop("_bucket")


def _first_names(docs: DataFrame, key: list[str], norm: Column, size: int) -> DataFrame:
    """``key, pos, name`` of every block.

    Blocks that many documents share would meet in one sort bucket. They are found by counting hashes, at most
    ``1 / HOT_SHARE`` of them, and named through a small table that goes to the rows; the others are sorted.
    """
    blocks = docs.select(*key, F.explode(_blocks(norm, size)).alias("_b")).select(*key, "_b.pos", "_b.block")
    hashed = blocks.groupBy(F.xxhash64("block").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    hashed = cut(hashed)
    total = hashed.agg(F.sum("_n")).first()[0] or 0
    buckets = max(1, -(-total // PER_BUCKET))
    often = hashed.where(F.col("_n") >= max(2.0, total * HOT_SHARE)).select("_h")
    hot_rows = [r["_h"] for r in often.collect()]
    if not hot_rows:
        return cut(_sorted_names(blocks, ["block"], buckets).select(*key, "pos", "name"))
    hot = F.array(*[F.lit(h) for h in sorted(hot_rows)])
    marked = blocks.withColumn("_hot", F.array_contains(hot, F.xxhash64("block")))
    texts = marked.where("_hot").groupBy("block").agg(F.count(F.lit(1)).alias("_n"))
    named = cut(texts.select(F.col("block").alias("_block"), F.row_number().over(Window.orderBy("block")).cast("long").alias("_name")))
    rare = _sorted_names(marked.where(~F.col("_hot")), ["block"], buckets).select(*key, "pos", F.col("name"))
    common = marked.where("_hot").join(F.broadcast(named), F.col("block") == F.col("_block")).select(
        *key, "pos", (-F.col("_name")).alias("name")  # negative: apart from the bucket names
    )
    return cut(rare.unionByName(common))


def _pair(names: DataFrame, key: list[str], level: int) -> DataFrame:
    """Name adjacent pairs of names: half as many names per document. The pairs are combined before they are sorted."""
    spot = [*key, F.floor(F.col("pos") / 2).cast("int").alias("pos")]
    left = F.max(F.when(F.col("pos") % 2 == 0, F.col("name")))
    right = F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
    pairs = cut(names.groupBy(*spot).agg(left.alias("left"), right.alias("right")))
    distinct = pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("_n"))
    buckets = max(1, -(-pairs.count() // PER_BUCKET))
    named = cut(_sorted_names(distinct, ["left", "right"], buckets).select(F.col("left").alias("_l"), F.col("right").alias("_r"), "name"))
    return cut(pairs.join(named, (F.col("left") == F.col("_l")) & F.col("right").eqNullSafe(F.col("_r"))).select(*key, "pos", "name"))


def identities(docs: DataFrame, text: Column, block: int = BLOCK) -> DataFrame:
    """``doc_id, _key, level, name``: one row per document row; (level, name) is the same exactly for equal ``text``.

    The level is the number of pairings, which the number of blocks decides. Rows with the same id and text are
    identical rows and share one identity. Each level halves the names of a document, so even the longest text takes
    a logarithmic number of rounds and is never held whole.
    """
    key = ["doc_id", "_key"]
    rows = docs.select("doc_id", row_key().alias("_key"), text.alias("_norm")).where(F.lit(True))
    names = _first_names(rows, key, F.col("_norm"), block)
    level, out = 0, None
    while True:
        last = names.groupBy(*key).agg(F.max("pos").alias("_last"))
        sized = cut(names.join(last.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_last"),
                               F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).drop("_d", "_k"))
        whole = sized.where(F.col("_last") == 0).groupBy(*key).agg(F.max("name").alias("name")).withColumn("level", F.lit(level))
        out = whole if out is None else out.unionByName(whole)
        rest = sized.where(F.col("_last") > 0)
        if rest.isEmpty():
            return cut(out)
        names = _pair(rest.select(*key, "pos", "name"), key, level)
        level += 1


def exact_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting white space (``WHITE``); null counts as empty, and all empty texts
    are one group. Of equal texts the row with the most code points in the original text stays, then the smallest
    doc_id (nulls last). Rows that repeat a document id in a group stay or go together. Extra columns are left out.
    """
    rows = _grouped(docs, block)
    best = F.max_by("doc_id", F.struct("_chars", F.col("doc_id").isNotNull(), -F.col("doc_id")))
    groups = rows.groupBy("level", "name").agg(best.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.withColumnsRenamed({"level": "_level", "name": "_name"}))
    found = rows.join(groups, (F.col("level") == F.col("_level")) & (F.col("name") == F.col("_name")))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _grouped(docs: DataFrame, block: int) -> DataFrame:
    """``doc_id, _key, level, name, _chars, text_sha256`` of every row; (level, name) is the group of equal texts."""
    norm = without_white(text_of())
    named = identities(docs, norm, block)
    facts = docs.select("doc_id", row_key().alias("_key"), F.length(text_of()).cast("long").alias("_chars"), F.sha2(norm.cast("binary"), 256).alias("text_sha256"))
    ids = named.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "level", "name")
    return cut(facts.join(ids, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k"))).drop("_d", "_k"))


def without_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each group of equal texts, with its columns, chosen as in ``exact_duplicates``; of rows with the same
    id the one with the smallest hash of its text stays."""
    rows = _grouped(docs, block)
    first = F.struct((-F.col("_chars")).alias("fewer"), F.col("doc_id").isNull().alias("none"), "doc_id", "_key")
    best = cut(rows.groupBy(F.col("level").alias("_level"), F.col("name").alias("_name")).agg(F.min(first).alias("best")))
    found = rows.join(best, (F.col("level") == F.col("_level")) & (F.col("name") == F.col("_name")))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("_key") == F.col("best._key"))
    return without_rows(docs, cut(found.where(~stays).select("doc_id", "_key").distinct()), once=True)
