"""Fuzzy line deduplication: MinHash of character shingles, banding, exact verification, union-find. DataFrame functions only."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import let
from tidemark.llm.graph import components, unused
from tidemark.session import durable

#: Characters (UTF-16 units) of a shingle.
SHINGLE = 8
#: Lines as alike as this, by the Jaccard coefficient of their shingles, are one.
ALIKE = 0.8
#: Minima of a signature, the points of the affine plane of order three; a band is one of its twelve lines: any two minima share a band.
POINTS = 9
BANDS = [
    *[tuple(3 * x + (slope * x + start) % 3 for x in range(3)) for slope in range(3) for start in range(3)],
    *[tuple(3 * x + y for y in range(3)) for x in range(3)],
]
#: A pair at 0.8 agrees in all three minima of some band with probability 0.990, one at 0.85 with 0.9973, one at 0.9 with 0.9996.
#: Shingles of one generated row.
BLOCK = 8
#: Longs of the bitmap that bounds how much two lines have in common.
WORDS = 16
#: Those of the lines left after the first round.
FINE_WORDS = 32
#: At most so many lines to verify are sought by a broadcast of their digests (8 bytes each).
BROADCAST_LINES = 2_000_000
#: Pivots of a bucket in the second round.
PIVOTS = 64
#: Only lines with more bytes than this are looked at for repeats within.
LONG_LINE = 4096


def _with_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, row, pos, line)`` for each line that isn't blank, trimmed and in lower case; ``row`` is a digest of id and text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), text.alias("text"))
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "row", "pos", F.lower(F.trim("line")).alias("line")).where("line <> ''")


def _digests(line: Column) -> list[Column]:
    """128 bits in two longs that stand for the line."""
    return [F.xxhash64(line).alias("d1"), F.xxhash64(F.lit("line"), line).alias("d2")]


def _last_start(units: Column) -> Column:
    return F.greatest((F.octet_length(units) / 2).cast("int") - SHINGLE, F.lit(0))


def _shingle(units: Column, at: Column) -> Column:
    """The shingle of a text in UTF-16 that starts at a unit; bytes are cut in constant time, whatever the place."""
    return F.substring(units, at * 2 + 1, F.lit(2 * SHINGLE))


def _shingles(line: Column) -> Column:
    """The distinct shingles of a line, as their digests; a line shorter than a shingle is one."""

    def of(units: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(0), _last_start(units)), lambda i: F.xxhash64(_shingle(units, i))))

    return let(F.encode(line, "UTF-16BE"), of)  # encoded once, not for each shingle


def _starts() -> Column:
    """Where the blocks of ``BLOCK`` shingles of a row start, the last shingle of which is ``last``: one generated row each."""
    return F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(BLOCK)))


def _places() -> list[Column]:
    """The shingles of a block; the last one again, where there are fewer."""
    return [F.least(F.col("at") + k, F.col("last")) for k in range(BLOCK)]


def _signatures(lines: DataFrame) -> DataFrame:
    """``(d1, m0, m1, ...)`` for each different line.

    A generated row holds the hashes of ``BLOCK`` shingles; a minimum is that of the hash with some bits turned. Tasks merge what they
    have read before the shuffle, so a line that stands everywhere is one row from each.
    """
    chosen = random.Random(8)
    turns = [chosen.getrandbits(32) - (1 << 31) for _ in range(POINTS)]
    units = lines.select(F.xxhash64("line").alias("d1"), F.encode("line", "UTF-16BE").alias("units"))
    blocks = units.withColumn("last", _last_start(F.col("units"))).withColumn("at", _starts())
    hashed = blocks.select("d1", *[F.hash(_shingle(F.col("units"), place)).alias(f"h{k}") for k, place in enumerate(_places())])

    def least(turn: int) -> Column:
        return F.min(F.least(*[F.col(f"h{k}").bitwiseXOR(F.lit(turn).cast("int")) for k in range(BLOCK)]))

    return hashed.groupBy("d1").agg(*[least(turn).alias(f"m{i}") for i, turn in enumerate(turns)])


def _buckets(signatures: DataFrame) -> DataFrame:
    """``(key, d1, n)``: lines that share a band with others; ``n`` lines have the key."""
    bands = [F.xxhash64(F.lit(b), *[f"m{i}" for i in band]) for b, band in enumerate(BANDS)]
    rows = signatures.select("d1", F.explode(F.array(*bands)).alias("key")).repartition("key")  # one shuffle serves both sides of the join
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("d1").alias("least"), F.max("d1").alias("most"))
    return rows.join(shared.where("least <> most").hint("shuffle_hash"), "key").select("key", "d1", "n")


def _texts_of(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``(id, d1, line, set)`` of the lines whose first digest is wanted; ``id`` is the whole digest.

    A line is carried as its text or, if it repeats itself so much that this is shorter, as the set of its shingles; the
    other column is null. The wanted digests are broadcast if they are proven few, else joined.
    """
    first = durable(wanted.select("d1").distinct(), "digests")
    if first.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        first = F.broadcast(first)
    d1, d2 = _digests(F.col("line"))
    told = lines.select(d1, "line").join(first, "d1", "left_semi").select("d1", d2, "line").dropDuplicates(["d1", "d2"])
    told = told.withColumn("set", F.when(F.octet_length("line") > LONG_LINE, _shingles(F.col("line"))))
    repeats = F.col("set").isNotNull() & (F.size("set") * 8 <= F.octet_length("line"))
    return told.select(
        F.struct("d1", "d2").alias("id"), "d1", F.when(~repeats, F.col("line")).alias("line"), F.when(repeats, F.col("set")).alias("set")
    )


def _prints(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``(id, n, w0, w1, ...)``: at least the number of the line's shingles, and a bitmap in which each of them sets a bit.

    Where the set of a line is given, ``n`` is exact; else shingles that repeat count again.
    As for signatures, a generated row holds ``BLOCK`` shingles, so none of them is a row of its own.
    """
    last = F.when(F.col("set").isNotNull(), F.size("set") - 1).otherwise(_last_start(F.encode("line", "UTF-16BE")))
    blocks = texts.select("id", "set", F.encode("line", "UTF-16BE").alias("units"), last.alias("last")).withColumn("at", _starts())
    hashes = [F.coalesce(F.get("set", place), F.xxhash64(_shingle(F.col("units"), place))).alias(f"h{k}") for k, place in enumerate(_places())]
    split = blocks.select("id", "last", *hashes).select(
        "id", "last",
        *[F.shiftrightunsigned(f"h{k}", 6).bitwiseAND(F.lit(words - 1)).cast("int").alias(f"word{k}") for k in range(BLOCK)],
        *[F.expr(f"shiftleft(1L, CAST(h{k} & 63 AS INT))").alias(f"bit{k}") for k in range(BLOCK)],
    )

    def word(i: int) -> Column:
        bits = [F.when(F.col(f"word{k}") == i, F.col(f"bit{k}")).otherwise(F.lit(0).cast("long")) for k in range(BLOCK)]
        return F.bit_or(reduce(Column.bitwiseOR, bits)).alias(f"w{i}")

    return split.groupBy("id").agg((F.max("last") + 1).cast("long").alias("n"), *map(word, range(words)))


def _may_be_alike(words: int = WORDS) -> Column:
    """Whether sizes and bitmaps allow lines a and b a coefficient of ``ALIKE``.

    A bit that only one line has set is a shingle that the other lacks: what both have in common is at most half of the sum of their sizes less these. It stays
    a bound where sizes are too great, since the sizes raise it by more than they raise what is needed.
    """
    n = F.col("a.n") + F.col("b.n")
    lacking = reduce(lambda s, i: s + F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))), range(words), F.lit(0))
    return (n - lacking) * (1 + ALIKE) >= 2 * ALIKE * n - 1e-6


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs``, a stored table, whose exact Jaccard coefficient is at least ``ALIKE``.

    Texts of other lines stay where they are: the digests wanted are broadcast if they are proven few (two of a pair), else joined. Few lines
    stand on side a, often many times: their texts travel once and become sets where the pairs meet them.
    """
    wanted = pairs.select(F.col("a.d1").alias("d1")).union(pairs.select(F.col("b.d1"))).distinct()
    if pairs.limit(BROADCAST_LINES // 2 + 1).count() <= BROADCAST_LINES // 2:
        wanted = F.broadcast(wanted)
    texts = texts.join(wanted, "d1", "left_semi")
    lines = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"), F.col("set").alias("set_b"))
    sides = texts.withColumnRenamed("id", "a").join(pairs.select("a").distinct(), "a", "left_semi").repartition(F.col("a"))
    sides = sides.select("a", F.coalesce("set", _shingles(F.col("line"))).alias("set_a"))
    told = pairs.join(lines, "b").join(sides, "a")
    sets = told.select("a", "b", "set_a", F.coalesce("set_b", _shingles(F.col("line_b"))).alias("set_b"))
    both = sets.select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("n"))
    return both.where(F.col("n") >= ALIKE * (F.col("n_a") + F.col("n_b") - F.col("n"))).select("a", "b")


def _crowds(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows, with their ``root``, of the buckets whose lines aren't all of one component."""
    told = rows.join(known.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    spread = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return told.join(spread.select("key"), "key", "left_semi")


def _joined(met: DataFrame, prints: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, root)``: components of the lines ``(key, id, degree)`` over the links between lines alike in one bucket. Exact.

    In each round the lines of each bucket with the highest degree, the pivots, are compared with all others of the bucket that are not known to be in their
    component, and leave the bucket; then components are formed anew, and buckets within one component are done with. So no
    two lines stay uncompared unless links join them anyway, and a crowd of lines alike costs one
    comparison each, not one for each pair. The degree is how many lines one meets in all its buckets: the original of many
    copies meets most, and so joins them at once. The first round has one pivot a bucket and settles most of them, so its rows are digests only. What
    is left has ``PIVOTS`` pivots, then eight times as many in each round, for buckets whose lines have little in common, and carries
    exact sizes, finer bitmaps and all its buckets: of those that two lines share only the one with the least key compares them, so that each pair is made once.
    Sizes and bitmaps rule out most pairs before a text is fetched.
    """
    rows = met.repartition("key")  # one shuffle serves both sides of the join
    star = rows.groupBy("key").agg(F.min_by("id", F.struct(-F.col("degree"), F.col("id"))).alias("a"))
    rest = durable(rows.join(star.hint("shuffle_hash"), "key").where("id <> a").select("key", "id", "degree", "a"), "line-stars")
    pairs = rest.select("a", F.col("id").alias("b")).distinct().alias("p")
    pairs = pairs.join(prints.alias("a"), F.col("p.a") == F.col("a.id")).join(prints.alias("b"), F.col("p.b") == F.col("b.id"))
    pairs = durable(pairs.where(_may_be_alike()).select("p.a", "p.b"), "line-pairs")
    known = durable(components(_alike(pairs, texts)), "line-components")
    rest = durable(_crowds(rest.drop("a"), known), "crowds")
    columns, pivots, told = rest.columns, PIVOTS, None
    keys = rest.groupBy("id").agg(F.collect_list("key").alias("keys"))
    while not rest.isEmpty():
        if told is None:
            sets = texts.join(keys.select("id"), "id", "left_semi").select("id", "line", F.coalesce("set", _shingles(F.col("line"))).alias("set"))
            told = durable(keys.join(_prints(sets, FINE_WORDS), "id"), "crowd-prints")
        order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "id"))
        ranked = durable(rest.join(told, "id").withColumn("place", order), "ranked-lines")
        chosen, others = ranked.where(F.col("place") <= pivots).alias("a"), ranked.alias("b")
        meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.place") < F.col("b.place")) & (F.col("a.root") != F.col("b.root"))
        sizes = F.least("a.n", "b.n") >= ALIKE * F.greatest("a.n", "b.n") - 1e-6
        here = F.col("a.key") == F.array_min(F.array_intersect("a.keys", "b.keys"))
        pairs = chosen.join(others, meet & sizes & here & _may_be_alike(FINE_WORDS)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        pairs = durable(pairs, "line-pairs")
        links = durable(_alike(pairs, texts), "line-links")
        left = ranked.where(F.col("place") > pivots).select(columns)
        if not links.isEmpty():
            known = durable(components(links.union(known)), "line-components")
        rest = durable(_crowds(left.drop("root"), known).select(columns), "crowds")
        pivots *= 8
    return known


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(d1, d2, owner)`` of the lines that occur more than once or resemble another.

    ``owner`` is the smallest document that has the line. Of each component the line whose owner is the smallest is ``kept``.
    """
    lines = _with_lines(docs, id_col, text_col)
    buckets = durable(_buckets(_signatures(lines)), "line-buckets")
    texts = durable(_texts_of(buckets, lines), "line-texts")
    degrees = buckets.groupBy("d1").agg(F.sum("n").alias("degree"))
    prints = durable(_prints(texts), "line-prints")
    met = buckets.select("key", "d1").join(degrees, "d1").join(prints.select("id", F.col("id.d1").alias("d1")), "d1").drop("d1")
    linked = _joined(met, prints, texts).select("node.d1", "node.d2", "root")
    stated = lines.select("doc_id", *_digests(F.col("line"))).groupBy("d1", "d2")
    stated = stated.agg(F.min("doc_id").alias("owner"), F.count("*").alias("times")).join(linked, ["d1", "d2"], "left")
    stated = durable(stated.where("times > 1 OR root IS NOT NULL"), "repeated-lines")
    first = F.struct(F.col("owner").isNull(), F.col("owner"), F.col("d1"), F.col("d2"))
    best = stated.where("root IS NOT NULL").groupBy("root").agg(F.min(first).alias("best"))
    return stated.join(best, "root", "left").select(
        "d1", "d2", "owner", (F.col("root").isNull() | (first == F.col("best"))).alias("kept")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with lines repeated or nearly repeated anywhere taken out of the text; all rows and columns stay.

    Lines are compared trimmed and in lower case; lines with a Jaccard coefficient of at least ``ALIKE`` are linked, and of each component
    one line stays where it stands first: in the document with the smallest id that has it. Blank lines stay. A null text stays
    null, a document may be left with blank lines or an empty text. Rows without an id come last; rows that share an id are one
    document, and equal rows are treated alike. An empty table stays empty.
    """
    classes = durable(line_classes(docs, id_col, text_col), "line-classes")
    places = _with_lines(docs, id_col, text_col).select("doc_id", "row", "pos", *_digests(F.col("line")))
    told = places.join(classes, ["d1", "d2"])
    first = F.min(F.struct("row", "pos")).over(Window.partitionBy("doc_id", "d1", "d2"))  # the rows of one document only
    stays = F.col("kept") & F.col("doc_id").eqNullSafe(F.col("owner")) & (F.struct("row", "pos") == F.col("first"))
    gone = told.withColumn("first", first).where(~stays)
    id_name, row_name, gone_name = (unused(docs, name) for name in ("_id", "_row", "_gone"))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias(gone_name))
    gone = gone.select(F.col("doc_id").alias(id_name), F.col("row").alias(row_name), gone_name).hint("shuffle_hash")  # texts aren't sorted for it
    text = F.col(f"`{text_col}`").cast("string")
    row = F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(text, F.lit("")))
    marked = docs.join(gone, (row == F.col(row_name)) & F.col(f"`{id_col}`").eqNullSafe(F.col(id_name)), "left")

    def without_gone(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_name))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    shorter = let(F.split(text, "\n", -1), without_gone)
    whole = F.col(f"`{text_col}`")
    return marked.withColumn(text_col, F.when(F.col(gone_name).isNull(), whole).otherwise(shorter)).drop(row_name, gone_name, id_name)
