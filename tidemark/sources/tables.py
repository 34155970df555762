"""Catalogue tables derived from the given star schema.

The given tables hold no catalogue of projects, so each catalogue table is a view of them: an order
is a project, its customer's market segment the source, the customer's nation and the order year the
event, part brands the tags and part types the themes. All views are lazy and column-pruned: a
query that needs no tags never reads ``lineitem``, since its join side has a unique key.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text
from tidemark.functions.tags import Theme, Vocabulary
from tidemark.session import dealt, durable

# The closed list of sources of this catalogue and the run that collects each of them.
SOURCE_RUNS = {"automobile": 2, "building": 3, "furniture": 4, "household": 5, "machinery": 6}
SOURCES = list(SOURCE_RUNS)
IMPORT_RUN = 1
BROKEN_RUN = 7  # a collection of the first source whose parser lost two fields
FIRST_STAGED_YEAR = 1999
LAST_IMPORTED_YEAR = 1999

VOCABULARY = Vocabulary(
    categories={
        "small": tuple(f"Brand#{n}" for n in range(1, 13)),
        "large": tuple(f"Brand#{n}" for n in range(13, 26)),
    },
    aliases={f"b{n}": f"Brand#{n}" for n in range(1, 26)},
    themes=tuple(
        Theme(slug, f"{slug.capitalize()} parts", f"Projects that use {slug} parts")
        for slug in (
            "bulk", "economy", "jumbo", "large", "luxury", "medium", "mini", "promo", "small",
            "standard",
        )
    ),
)

# Tags looked for in the documents: short words of their invented prose.
WORD_VOCABULARY = Vocabulary(
    categories={
        "short": ("Rewh", "Orre", "Von", "Sta"),
        "long": ("Thatin", "Ononst", "Inoran", "Orantion", "Hehely"),
        "symbols": ("De La", "$$$"),
    },
    aliases={"rewhs": "Rewh", "auf der": "Von", "inorans": "Inoran"},
    themes=(Theme("prose", "Prose", "Running text"),),
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_views: dict[tuple, tuple[SparkSession, DataFrame]] = {}


def view(build):
    """Build a view once per session and folder, as a named view of a catalog would be."""

    @wraps(build)
    def known(spark: SparkSession, folder: str) -> DataFrame:
        key = (id(spark), build.__module__, build.__name__, folder)
        if key not in _views:
            _views[key] = (spark, build(spark, folder))
        return _views[key][1]

    return known


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the attributes of their part."""
    lines = dealt(read(spark, folder, "lineitem"))
    parts = read(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


@view
def order_tags(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order that has lines. The different parts of an order are gathered before the shuffle, as one set that the
    sets of brands, types and names are taken from, so an order with very many lines stays small."""
    returned = F.col("l_returnflag") == "R"
    lines = dealt(read(spark, folder, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_linenumber", returned.alias("is_return"),
        F.coalesce(F.col("l_returnflag") == "A", F.lit(False)).alias("claimed"),
        F.coalesce(returned & (F.col("l_discount") >= 0.05), F.lit(False)).alias("returned"),
    )
    parts = read(spark, folder, "part").select("p_partkey", "p_brand", F.lower("p_type").alias("p_type"), "p_name")
    gathered = (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(F.col("l_orderkey").alias("tag_orderkey"))
        .agg(
            F.collect_set(F.struct("p_brand", "p_type", "p_name", "claimed", "returned")).alias("parts"),
            F.max("is_return").alias("has_return"),
            F.max("l_linenumber").alias("last_line"),
        )
    )

    def of_parts(name: str, keep: str | None = None) -> Column:
        chosen = F.filter("parts", lambda x: x[keep]) if keep else F.col("parts")
        return F.array_sort(F.array_compact(F.array_distinct(F.transform(chosen, lambda x: x[name]))))

    return gathered.select(
        "tag_orderkey",
        of_parts("p_brand").alias("brands"),
        of_parts("p_type").alias("types"),
        of_parts("p_name").alias("part_names"),
        of_parts("p_brand", "claimed").alias("claimed_brands"),
        of_parts("p_brand", "returned").alias("returned_brands"),
        "has_return",
        "last_line",
    )


@view
def dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer and nation. No hint: Spark broadcasts a side by its size."""
    orders = dealt(read(spark, folder, "orders"))
    customers = read(spark, folder, "customer")
    nations = read(spark, folder, "nation")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )


@view
def projects(spark: SparkSession, folder: str) -> DataFrame:
    """The whole corpus with the declared columns, plus ``order_key`` and the enrichment inputs."""
    joined = dated_orders(spark, folder).join(
        order_tags(spark, folder), F.col("o_orderkey") == F.col("tag_orderkey"), "left"
    )
    nothing = F.array().cast("array<string>")
    source = F.lower("c_mktsegment")
    slug = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    year = F.year("o_orderdate").cast("string")
    winner = F.col("o_orderstatus") == "F"
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    tags = F.coalesce("brands", nothing)
    return joined.select(
        text.project_id(source, slug).alias("id"),
        source.alias("source"),
        F.concat(F.lit("https://"), source, F.lit(".example/p/"), slug).alias("source_url"),
        F.concat_ws("-", F.lower("n_name"), year).alias("hackathon_slug"),
        F.concat_ws(" ", "n_name", year).alias("hackathon_name"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("hackathon_date"),
        F.slice(F.coalesce("types", nothing), 1, VOCABULARY.max_themes).alias("theme_tags"),
        F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat(F.lit("Made of "), F.array_join("part_names", ", ")).alias("description"),
        F.when(
            F.col("o_orderpriority") != "1-URGENT",
            F.concat_ws(" ", F.col("o_orderpriority"), F.lit("order of"), F.col("c_name")),
        ).alias("short_description"),
        F.when(winner & (rank <= 3), rank).alias("placement"),
        F.col("o_orderpriority").alias("raw_placement"),
        winner.alias("is_winner"),
        F.when(winner, F.try_element_at("part_names", F.lit(-1))).alias("prize_track"),
        tags.alias("tech_stack"),
        F.when(F.col("has_return"), "github")
        .when(F.size(tags) > 0, "llm")
        .otherwise("none")
        .alias("stack_source"),
        F.col("last_line").cast("int").alias("team_size"),
        F.col("c_name").alias("team_name"),
        F.when(F.col("has_return"), F.concat(F.lit("https://github.com/shop/"), slug)).alias("repo_url"),
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("demo/"), slug))
        .when(F.col("c_acctbal") < 8000, F.concat(F.lit("HTTP://demo.example/"), slug))
        .alias("demo_url"),
        F.to_timestamp("o_orderdate").alias("scraped_at"),
        F.col("o_orderkey").alias("order_key"),
        F.year("o_orderdate").alias("order_year"),
        F.coalesce("claimed_brands", nothing).alias("claimed_brands"),
        F.coalesce("returned_brands", nothing).alias("returned_brands"),
    )


@view
def hackathons(spark: SparkSession, folder: str) -> DataFrame:
    """Observed events, and next year's announced ones that have no project yet."""
    orders = dated_orders(spark, folder)
    held = orders.select(
        F.lower("c_mktsegment").alias("source"),
        "n_name",
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")).alias("day"),
    )
    nations = read(spark, folder, "nation")
    customers = read(spark, folder, "customer")
    announced = customers.join(nations, customers.c_nationkey == nations.n_nationkey).select(
        F.lower("c_mktsegment").alias("source"),
        "n_name",
        F.lit(2002).alias("year"),
        F.lit(None).cast("date").alias("day"),
    )
    return (
        held.unionByName(announced)
        .groupBy("source", "n_name", "year")
        .agg(F.max("day").alias("hackathon_date"))
        .select(
            "source",
            F.concat_ws("-", F.lower("n_name"), F.col("year").cast("string")).alias("slug"),
            F.concat_ws(" ", "n_name", F.col("year").cast("string")).alias("name"),
            "hackathon_date",
            F.concat(
                F.lit("https://"), "source", F.lit(".example/e/"), F.lower("n_name"),
                F.lit("-"), F.col("year").cast("string"),
            ).alias("url"),
            F.make_timestamp(F.col("year"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0)).alias("scraped_at"),
        )
    )


@view
def stored_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus as a table in the shared folder, for jobs that import and stage it: its joins are made once."""
    return durable(projects(spark, folder), "projects", "zstd")


@view
def serving(spark: SparkSession, folder: str) -> DataFrame:
    """The promoted table: the imported years, with a vector where one is known for the key."""
    return imported(projects(spark, folder), spark, folder)


def imported(rows: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """The promoted table, of the given projects."""
    vectors = read(spark, folder, "embeddings").select(
        F.col("vec_id").alias("order_key"), "embedding"
    )
    return rows.filter(F.col("order_year") <= LAST_IMPORTED_YEAR).join(vectors, "order_key", "left")


@view
def staging(spark: SparkSession, folder: str) -> DataFrame:
    """Staged rows of all runs: the import, one collection per source, and a broken collection."""
    return staged(projects(spark, folder))


def staged(rows: DataFrame) -> DataFrame:
    """Staged rows of all runs, of the given projects: the import, one collection per source, and a broken collection.

    Collections start in the last imported year, so they update some rows and insert others; texts
    of high-priority rows change.
    """
    late = F.col("order_year") >= FIRST_STAGED_YEAR
    runs = [F.when(F.col("order_year") <= LAST_IMPORTED_YEAR, F.lit(IMPORT_RUN).cast("long"))]
    runs += [F.when(late & (F.col("source") == s), F.lit(r).cast("long")) for s, r in SOURCE_RUNS.items()]
    runs += [F.when(late & (F.col("source") == SOURCES[0]), F.lit(BROKEN_RUN).cast("long"))]
    run = F.col("scrape_run_id")
    return (
        rows.withColumn("scrape_run_id", F.explode(F.array_compact(F.array(*runs))))
        .withColumn(
            "title",
            F.when((run != IMPORT_RUN) & (F.col("raw_placement") == "2-HIGH"), F.concat("title", F.lit(" v2")))
            .otherwise(F.col("title")),
        )
        .withColumn("description", F.when(run != BROKEN_RUN, F.col("description")))
        .withColumn("repo_url", F.when(run != BROKEN_RUN, F.col("repo_url")))
    )


@view
def run_events(spark: SparkSession, folder: str) -> DataFrame:
    """Append-only log of run states; each run's row count comes from its staged rows."""
    counts = staging(spark, folder).groupBy(F.col("scrape_run_id").alias("run_id")).agg(
        F.count("*").alias("n_scraped")
    )
    one_source = F.lit(None).cast("string")
    for source, run in SOURCE_RUNS.items():
        one_source = F.when(F.col("run_id") == run, F.lit(source)).otherwise(one_source)
    one_source = F.when(F.col("run_id") == BROKEN_RUN, F.lit(SOURCES[0])).otherwise(one_source)
    path = F.when(
        F.col("run_id") == IMPORT_RUN, F.array(*map(F.lit, ["running", "validated", "promoted"]))
    ).when(
        F.col("run_id") == SOURCE_RUNS["machinery"], F.array(*map(F.lit, ["running", "scraped", "validated"]))
    ).otherwise(F.array(*map(F.lit, ["running", "scraped"])))
    return counts.select(
        "run_id", "n_scraped", one_source.alias("source"), F.posexplode(path).alias("seq", "status")
    ).select(
        "run_id",
        F.col("seq").cast("long"),
        "source",
        F.when(F.col("run_id") == IMPORT_RUN, "import").otherwise("scrape").alias("kind"),
        "status",
        "n_scraped",
        F.lit(None).cast("long").alias("n_promoted"),
    )


@view
def repo_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags found in repositories (the reliable pass); the list may be empty."""
    return projects(spark, folder).filter(F.col("repo_url").isNotNull()).select(
        F.col("id").alias("project_id"), "source", "repo_url",
        F.col("returned_brands").alias("tech_stack"),
    )


@view
def model_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags a language model claimed (the second pass); the list may be empty."""
    rows = projects(spark, folder).filter(
        F.col("description").isNotNull() & (F.col("raw_placement") != "3-MEDIUM")
    )
    return rows.select(
        F.col("id").alias("project_id"), "source", F.col("claimed_brands").alias("tech_stack"),
        "theme_tags",
    )


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the searchable corpus: documents without what other tables tell of them, so that reading them needs no join."""
    lines = F.split("text", "\n")
    return dealt(read(spark, folder, "documents")).select(
        F.col("doc_id").alias("id"),
        "source",
        "lang",
        F.try_element_at(lines, F.lit(1)).alias("title"),
        F.try_element_at(lines, F.lit(2)).alias("short_description"),
        F.col("text").alias("description"),
    )


@view
def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Searchable corpus: documents with their vector (if any) and quality label."""
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("label_doc"), "quality")
    docs = texts(spark, folder)
    return (
        docs.join(vectors, F.col("id") == F.col("vec_id"), "left")
        .join(labels, F.col("id") == F.col("label_doc"), "left")
        .select(*docs.columns, "embedding", (F.coalesce("quality", F.lit(0)) == 1).alias("is_winner"))
    )


@view
def word_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Model tags for documents, where the model repeated its whole list instead of reading."""
    dump = F.array(*map(F.lit, WORD_VOCABULARY.canonical))
    return read(spark, folder, "documents").select(
        F.col("doc_id").alias("project_id"),
        F.when(F.col("lang") == "es", F.array().cast("array<string>")).otherwise(dump).alias("tech_stack"),
    )
