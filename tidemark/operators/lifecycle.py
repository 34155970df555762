"""Table lifecycle: deduplicate, stage, upsert, and write vectors back.

Parquet has no MERGE, so an upsert is a plan. Of two stored tables only ids travel: they tell the places of
the rows that both sides have, and each side is read once more with these places marked. Any other target meets
the batch in a left join, which is a broadcast while the batch is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import model
from tidemark.session import durable


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order.

    An aggregate, not a window: repeats of a hot key collapse on the map side instead of meeting in
    one task. ``order`` must be unique within a key.
    """
    values = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*keys).agg(first.alias("first")).select(*keys, "first.*")


def _digest(keys: list[str]) -> Column:
    """Stands for the keys where they travel: rows of one key share it, and the few rows of other keys that do are told apart by the keys."""
    return F.xxhash64(*keys)


def _shared_digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The digests that several rows have, as column ``_digest_of_keys``."""
    digests = rows.select(_digest(keys).alias("_digest_of_keys")).groupBy("_digest_of_keys").agg(F.count("*").alias("n"))
    return durable(digests.where("n > 1").select("_digest_of_keys"), "repeated-keys")


def first_of_few(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As :func:`first_wins`, for stored rows of which few share a key: of all rows only a digest of the key travels, and those rows whole whose digest repeats."""
    repeated = _shared_digests(rows, keys)
    same = _digest(keys) == F.col("_digest_of_keys")
    chosen = first_wins(rows.join(repeated, same, "left_semi"), keys, order)
    return rows.join(repeated, same, "left_anti").select(*chosen.columns).unionByName(chosen)


def distinct_of_few(rows: DataFrame) -> DataFrame:
    """The different rows of stored ones of which few repeat: of all rows only a digest travels."""
    repeated = _shared_digests(rows, rows.columns)
    same = _digest(rows.columns) == F.col("_digest_of_keys")
    return rows.join(repeated, same, "left_anti").unionByName(rows.join(repeated, same, "left_semi").distinct())


def known_keys(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of ``known`` that rows have, for stored ones that share few: the keys themselves travel only where the digest is on both sides."""
    left, right = (frame.select(_digest(keys).alias("_digest_of_keys")) for frame in (known, rows))
    shared = durable(left.join(right, "_digest_of_keys", "left_semi").distinct(), "shared-keys")
    same = _digest(keys) == F.col("_digest_of_keys")
    few, own = (frame.select(*keys).join(shared, same, "left_semi") for frame in (known, rows))
    return durable(few.join(own, keys, "left_semi"), "known-keys")


def collisions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows :func:`first_wins` drops."""
    per_key = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("total"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("collisions")
    )


def bag_union(parts: list[DataFrame]) -> DataFrame:
    """Concatenate batches of several sources, by column name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def stage_batch(batch: DataFrame, staged: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a batch that its run does not hold yet, the first of each id."""
    keys = ["scrape_run_id", "id"]
    return first_wins(batch, keys, order).join(staged.select(*keys), keys, "left_anti")


def replace_rows(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace on the keys."""
    kept = current.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch.select(*current.columns))


def _text_changed() -> Column:
    same = F.lit(True)
    for column in model.EMBEDDED_TEXT:
        same &= F.col(column).eqNullSafe(F.col(f"new.{column}"))
    return ~same


def promote_upsert(target: DataFrame, batch: DataFrame, stored: bool = False) -> DataFrame:
    """The target after a batch: matched rows take every column of the batch, new rows are added.

    A vector survives only while the text it was computed from stays the same; new rows have none.
    ``change`` says what happened to the row. The batch must hold each id once, and so must a target that is ``stored``,
    as the batch then is, in files: rows of either stay where they are.
    """
    columns = [c for c in model.PROJECT_COLUMNS if c != "id"]
    if stored and target.inputFiles() and batch.inputFiles():
        return _upsert_in_place(target, batch, columns)
    incoming = batch.select("id", F.struct(*columns).alias("new"))
    hit = F.col("new").isNotNull()
    kept = target.join(incoming, "id", "left").select(
        "id",
        *[F.when(hit, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.when(~hit | ~_text_changed(), F.col("embedding")).alias("embedding"),
        F.when(hit, "updated").otherwise("kept").alias("change"),
    )
    known = target.select("id").join(incoming.select("id"), "id", "left_semi")
    added = incoming.join(known, "id", "left_anti").select(
        "id",
        "new.*",
        F.lit(None).cast(target.schema["embedding"].dataType).alias("embedding"),
        F.lit("inserted").alias("change"),
    )
    return kept.unionByName(added)


# Fixed value: rows of a file that one bitmap of Spark's bitmap functions covers.
_BITS = 32768
#: Bitmaps that are broadcast without asking for their size: 32 MB, the places of 268 million rows. Beyond, Spark chooses the join.
MOST_BITMAPS = 8192


def _place(frame: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of a stored table, and where each row stands: its file and its number in the file."""
    return frame.select(*columns, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _marked(frame: DataFrame, places: DataFrame) -> DataFrame:
    """A stored table with the column ``_hit``: whether a row stands at one of the places, which come as bits, one for each row of the table."""
    block = F.floor(F.col("_row") / _BITS).alias("_block")
    bits = F.bitmap_construct_agg(F.col("_row") % _BITS).alias("_bits")
    maps = durable(places.select("_file", block, "_row").groupBy("_file", "_block").agg(bits), "places")
    small = maps.limit(MOST_BITMAPS + 1).count() <= MOST_BITMAPS
    placed = _place(frame, "*").withColumn("_block", block).join(F.broadcast(maps) if small else maps, ["_file", "_block"], "left")
    position = (F.col("_row") % _BITS).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.select(*frame.columns, F.coalesce(F.getbit(byte, position % 8) == 1, F.lit(False)).alias("_hit"))


def _upsert_in_place(target: DataFrame, batch: DataFrame, columns: list[str]) -> DataFrame:
    """:func:`promote_upsert` of stored tables. Rows that only one side has are written as they are read, and so are those of the batch that
    replace one without a vector; texts travel only to compare them with those that a vector was computed from."""
    ids = _place(batch, "id").withColumnsRenamed({"_file": "_new_file", "_row": "_new_row"})
    pairs = durable(_place(target, "id").join(ids, "id").drop("id"), "matches")
    old = _marked(target, pairs.select("_file", "_row"))
    new = _marked(batch, pairs.select(F.col("_new_file").alias("_file"), F.col("_new_row").alias("_row")))
    texts = F.struct(*model.EMBEDDED_TEXT).alias("new")
    vectors = durable(old.where(F.col("_hit") & F.col("embedding").isNotNull()).select("id", texts, "embedding"), "old-vectors")
    updated = new.where("_hit").join(vectors, "id", "left").select(
        "id", *columns, F.when(~_text_changed(), F.col("embedding")).alias("embedding"), F.lit("updated").alias("change")
    )
    added = new.where("NOT _hit").select(
        "id", *columns, F.lit(None).cast(target.schema["embedding"].dataType).alias("embedding"), F.lit("inserted").alias("change")
    )
    kept = old.where("NOT _hit").select("id", *columns, "embedding", F.lit("kept").alias("change"))
    return kept.unionByName(updated).unionByName(added)


def promote_summary(upserted: DataFrame) -> DataFrame:
    """Rows promoted, and how many of them need a (new) vector."""
    touched = F.col("change") != "kept"
    return upserted.agg(
        F.count_if(touched).alias("promoted"),
        F.count_if(touched & F.col("embedding").isNull()).alias("to_encode"),
    )


def hackathon_upsert(target: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Events after a batch: the name is replaced, a known date is never lost, the url stays."""
    keys = ["source", "slug"]
    incoming = batch.select(*keys, F.struct("name", "hackathon_date", "url").alias("new"))
    hit = F.col("new").isNotNull()
    kept = target.join(incoming, keys, "left").select(
        *keys,
        F.when(hit, F.col("new.name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("new.hackathon_date", "hackathon_date").alias("hackathon_date"),
        "url",
        F.when(hit, now).otherwise(F.col("scraped_at")).alias("scraped_at"),
    )
    added = incoming.join(target.select(*keys), keys, "left_anti").select(*keys, "new.*", now.alias("scraped_at"))
    return kept.unionByName(added)


def embed_writeback(target: DataFrame, encoded: DataFrame) -> DataFrame:
    """Store vectors, but only where the text is still the one that was encoded.

    ``encoded`` carries the id, the encoded texts and the vector. ``written`` marks stored rows.
    """
    snapshot = encoded.select("id", F.struct(*model.EMBEDDED_TEXT).alias("new"), F.col("embedding").alias("vector"))
    fresh = F.col("new").isNotNull() & ~_text_changed()
    joined = target.join(snapshot, "id", "left").withColumn("written", F.coalesce(fresh, F.lit(False)))
    return joined.withColumn(
        "embedding", F.when(F.col("written"), F.col("vector")).otherwise(F.col("embedding"))
    ).drop("new", "vector")
