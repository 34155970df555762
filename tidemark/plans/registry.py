"""Every query by name: ``(spark, folder) -> DataFrame`` over the given tables.

Results are shaped for comparison: arrays become joined text, days become ISO text and doubles are
rounded. The operators themselves return native types.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import load_thresholds
from tidemark.functions import manifests, tags, text, vectors
from tidemark.operators import catalog, enrich, export, lifecycle, normalize, quality, search, trends
from tidemark.operators import postings as stored
from tidemark.session import durable, work_folder
from tidemark.sources import captures, pages, payloads, tables
from tidemark.sources.storage import Store
from tidemark.streaming import gate

Query = Callable[[SparkSession, str], DataFrame]

SOURCE, SLUG, THEME = "automobile", "nation_13-1999", "promo"
SEARCH_TEXT = 'thatin orre or "inoran hehely" rewh'
RELAXED_TEXT = "hehely unheardof ononst"
EXCLUDING_TEXT = "orantion -rewh"
QUERY_DOCUMENT = 7
VECTOR_SIZE = 64

_QUERIES: dict[str, Query] = {}


def shaped(frame: DataFrame) -> DataFrame:
    columns = []
    for field in frame.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DoubleType | T.FloatType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        columns.append(c.alias(field.name))
    return frame.select(*columns)


def query(build: Query) -> Query:
    """Register a function under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return shaped(build(spark, folder))

    _QUERIES[build.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- scans, projections, filters -------------------------------------------------------------


@query
def scan_items(spark, folder):
    return tables.projects(spark, folder).drop("order_key", "order_year", "claimed_brands", "returned_brands")


@query
def project_summary(spark, folder):
    return catalog.summary(tables.projects(spark, folder))


@query
def project_detail(spark, folder):
    projects = tables.projects(spark, folder)
    return catalog.detail(projects, projects.agg(F.min("id")).scalar())


@query
def select_for_extraction(spark, folder):
    return catalog.extraction_batch(tables.projects(spark, folder), [SOURCE, "building"])


@query
def filter_search(spark, folder):
    wanted = catalog.search_filter([SOURCE, "building"], True, date(1997, 1, 1), date(1999, 12, 31))
    return tables.projects(spark, folder).filter(wanted).select("id", "source", "hackathon_date", "title")


@query
def filter_sources_closed(spark, folder):
    known = catalog.known_sources([SOURCE, "nowhere"], tables.SOURCES)
    unknown = catalog.known_sources(["nowhere"], tables.SOURCES)
    projects = tables.projects(spark, folder)

    def count(kind, chosen):
        rows = projects.filter(catalog.search_filter(chosen))
        return rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("asked"), "n")

    return lifecycle.bag_union([count("some", known), count("unknown", unknown), count("none", None)])


@query
def filter_repo_host(spark, folder):
    return catalog.with_repository(tables.projects(spark, folder)).select("id", "repo_url")


@query
def embed_queue(spark, folder):
    return catalog.work_queue(tables.documents(spark, folder)).select("id", "title")


@query
def embed_batches(spark, folder):
    return catalog.encode_batches(catalog.work_queue(tables.documents(spark, folder))).select(
        "id", "n_chars", F.md5("text").alias("text_md5")
    )


# --- events, themes, leaderboards ------------------------------------------------------------


@query
def corpus_stats(spark, folder):
    return catalog.corpus_stats(tables.projects(spark, folder), tables.hackathons(spark, folder))


@query
def leaderboard(spark, folder):
    return catalog.leaderboard(tables.projects(spark, folder), SOURCE, SLUG)


@query
def theme_projects(spark, folder):
    return catalog.theme_projects(tables.projects(spark, folder), THEME)


@query
def hackathon_candidates(spark, folder):
    return catalog.hackathon_candidates(
        tables.hackathons(spark, folder), tables.projects(spark, folder), SLUG
    ).drop("scraped_at")


@query
def hackathon_main(spark, folder):
    return catalog.hackathon_main(tables.hackathons(spark, folder), tables.projects(spark, folder)).select(
        "source", "slug", "name", "project_count", "rank", "role"
    )


@query
def theme_counts(spark, folder):
    return trends.theme_counts(tables.projects(spark, folder))


@query
def theme_index(spark, folder):
    themes = tags.theme_frame(spark, tables.VOCABULARY)
    return trends.theme_index(tables.projects(spark, folder), themes)


@query
def theme_detail_stats(spark, folder):
    theme = tables.VOCABULARY.theme(THEME)
    return trends.theme_detail(tables.projects(spark, folder), theme.slug)


@query
def theme_top_stacks(spark, folder):
    return trends.theme_top_stacks(tables.projects(spark, folder), THEME)


@query
def theme_win_rates(spark, folder):
    themes = tags.theme_frame(spark, tables.VOCABULARY)
    return trends.theme_win_rates(tables.projects(spark, folder), themes)


@query
def theme_low_win(spark, folder):
    themes = tags.theme_frame(spark, tables.VOCABULARY)
    return trends.crowded_low_win(trends.theme_win_rates(tables.projects(spark, folder), themes))


@query
def theme_saturation(spark, folder):
    return trends.saturation(tables.projects(spark, folder), THEME)


@query
def trend_saturation(spark, folder):
    return trends.saturation(tables.projects(spark, folder))


@query
def trend_lifecycle(spark, folder):
    return trends.lifecycle(trends.saturation(tables.projects(spark, folder)))


@query
def date_coverage(spark, folder):
    return trends.date_coverage(tables.projects(spark, folder))


@query
def stack_contrast(spark, folder):
    return trends.stack_contrast(tables.projects(spark, folder))


@query
def stack_lift(spark, folder):
    return trends.stack_lift(trends.stack_contrast(tables.projects(spark, folder), theme=THEME))


@query
def stack_lift_winners(spark, folder):
    return trends.stack_lift(trends.stack_contrast(tables.projects(spark, folder), winners_only=True))


@query
def stack_ztest(spark, folder):
    tested = trends.stack_ztest(trends.stack_lift(trends.stack_contrast(tables.projects(spark, folder))))
    return tested.select("tech", "z", "significant")


@query
def stack_p_values(spark, folder):
    tested = trends.stack_ztest(trends.stack_lift(trends.stack_contrast(tables.projects(spark, folder))))
    return tested.select("tech", "p_value")


@query
def team_size_correlation(spark, folder):
    return trends.team_size_correlation(tables.projects(spark, folder))


# --- search ----------------------------------------------------------------------------------


@query
def cosine_topk(spark, folder):
    documents = tables.documents(spark, folder)
    vector = search.vector_of(documents, QUERY_DOCUMENT)
    return search.cosine_topk(documents.select("id", "source", "embedding"), vector, 50).drop("embedding")


@query
def similar_items(spark, folder):
    found = search.similar_items(tables.documents(spark, folder), QUERY_DOCUMENT)
    return found.select("id", "source", "title", "is_winner", "distance")


@query
def similar_items_approx(spark, folder):
    return search.similar_items_approx(tables.documents(spark, folder), QUERY_DOCUMENT).select("id", "distance")


@query
def approx_recall(spark, folder):
    return search.approx_recall(tables.documents(spark, folder), QUERY_DOCUMENT, 20)


@query
def postings(spark, folder):
    rows = search.postings(tables.documents(spark, folder))
    return rows.groupBy("field", "term").agg(
        F.count("*").alias("n"), F.sum("id").alias("sum_id"), F.sum("pos").alias("sum_pos")
    )


@query
def lexical_search(spark, folder):
    documents = tables.documents(spark, folder)
    return search.lexical_topk(documents, search.parse_query(SEARCH_TEXT), search.CANDIDATES)


@query
def lexical_search_relaxed(spark, folder):
    documents = tables.documents(spark, folder)
    return search.lexical_topk(documents, search.parse_query(RELAXED_TEXT), search.CANDIDATES)


@query
def lexical_search_excluding(spark, folder):
    documents = tables.documents(spark, folder)
    return search.lexical_topk(documents, search.parse_query(EXCLUDING_TEXT), search.CANDIDATES)


@query
def lexical_search_cover_density(spark, folder):
    documents = tables.documents(spark, folder)
    return search.lexical_topk(documents, search.parse_query(SEARCH_TEXT), search.CANDIDATES, cover_density=True)


@query
def lexical_search_stemmed(spark, folder):
    documents = tables.documents(spark, folder)
    parsed = search.parse_query(SEARCH_TEXT)
    forms = search.word_forms(durable(search.lexicon(documents), "lexicon"), parsed)
    return search.lexical_topk(documents, parsed, search.CANDIDATES, forms=forms)


@tables.view
def _index(spark, folder):
    """The postings of the corpus, stored once for each session and folder."""
    index = stored.Index(spark, work_folder(spark, "index"))
    index.extend(tables.texts(spark, folder))
    return index


def _indexed(spark, folder, typed, stemmed):
    return stored.lexical_topk(_index(spark, folder), search.parse_query(typed), search.CANDIDATES, stemmed)


@query
def index_search(spark, folder):
    return _indexed(spark, folder, SEARCH_TEXT, stemmed=False)


@query
def index_search_relaxed(spark, folder):
    return _indexed(spark, folder, RELAXED_TEXT, stemmed=False)


@query
def index_search_excluding(spark, folder):
    return _indexed(spark, folder, EXCLUDING_TEXT, stemmed=False)


@query
def index_search_stemmed(spark, folder):
    return _indexed(spark, folder, SEARCH_TEXT, stemmed=True)


@query
def hybrid_search_stemmed(spark, folder):
    documents = tables.documents(spark, folder)
    lexical = _indexed(spark, folder, SEARCH_TEXT, stemmed=True)
    return search.hybrid_search(documents, SEARCH_TEXT, search.vector_of(documents, QUERY_DOCUMENT), lexical=lexical)


@query
def hybrid_search(spark, folder):
    documents = tables.documents(spark, folder)
    return search.hybrid_search(documents, SEARCH_TEXT, search.vector_of(documents, QUERY_DOCUMENT))


@query
def hybrid_search_filtered(spark, folder):
    documents = tables.documents(spark, folder)
    condition = catalog.search_filter(["src1", "src7", "src14"], winners_only=True)
    return search.hybrid_search(documents, SEARCH_TEXT, search.vector_of(documents, QUERY_DOCUMENT), condition)


@query
def hybrid_search_no_vector(spark, folder):
    return search.hybrid_search(tables.documents(spark, folder), SEARCH_TEXT, None)


# --- quality gate ----------------------------------------------------------------------------


def _gate_inputs(spark, folder):
    status = quality.run_status(tables.run_events(spark, folder))
    return tables.staging(spark, folder), tables.serving(spark, folder), status


def _gate_checks(spark, folder):
    staging, serving, status = _gate_inputs(spark, folder)
    return quality.quality_checks(staging, serving, quality.gate_runs(staging, status), load_thresholds())


@query
def quality_metrics(spark, folder):
    return quality.quality_metrics(tables.staging(spark, folder), quality.RUN_KEYS)


@query
def url_valid_rate(spark, folder):
    metrics = quality.quality_metrics(tables.staging(spark, folder), quality.RUN_KEYS)
    limit = load_thresholds().url_valid_min_rate
    return metrics.select(
        *quality.RUN_KEYS, "url_valid_rate", (F.col("url_valid_rate") >= limit).alias("passed")
    )


@query
def projects_per_hackathon(spark, folder):
    return quality.projects_per_hackathon(tables.staging(spark, folder), quality.RUN_KEYS)


@query
def overlap_drop(spark, folder):
    staged = quality.projects_per_hackathon(tables.staging(spark, folder), quality.RUN_KEYS)
    current = quality.projects_per_hackathon(tables.serving(spark, folder), ["source"])
    return quality.overlap_drop(staged, current)


@query
def anchor_run(spark, folder):
    staging, _, status = _gate_inputs(spark, folder)
    return quality.anchor_runs(staging, status)


@query
def quality_checks(spark, folder):
    return _gate_checks(spark, folder).drop("position")


@query
def quality_bootstrap(spark, folder):
    staging, serving, status = _gate_inputs(spark, folder)
    nothing_promoted = status.filter(F.col("status") != "promoted")
    pending = quality.gate_runs(staging, nothing_promoted)
    checks = quality.quality_checks(staging, serving.filter(F.lit(False)), pending, load_thresholds())
    return checks.select("scrape_run_id", "source", "check_name", "passed", "note")


@query
def quality_verdict(spark, folder):
    return quality.verdicts(_gate_checks(spark, folder))


@query
def check_report(spark, folder):
    return quality.check_report(_gate_checks(spark, folder))


@query
def gate_outcome(spark, folder):
    status = quality.run_status(tables.run_events(spark, folder))
    return gate.outcomes(_gate_checks(spark, folder), status)


@query
def constraint_checks(spark, folder):
    """All rows are checked; four of the five sources are declared known, so that the rule for sources has violations to count."""
    projects = tables.projects(spark, folder)
    return quality.constraint_checks(projects, tables.hackathons(spark, folder), tables.SOURCES[:4])


# --- lifecycle -------------------------------------------------------------------------------


@query
def run_status(spark, folder):
    return quality.run_status(tables.run_events(spark, folder)).drop("n_promoted")


@query
def pending_runs(spark, folder):
    status = quality.run_status(tables.run_events(spark, folder))
    latest = quality.latest_validated_run(status).scalar()
    return quality.pending_runs(status).select(
        "run_id", "source", "status", (F.col("run_id") == latest).alias("latest_validated")
    ).orderBy("run_id")


LINE_ORDER = [
    "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


@query
def dedup_first_wins(spark, folder):
    lines = tables.read(spark, folder, "lineitem")
    kept = lifecycle.first_wins(lines, ["l_orderkey", "l_linenumber"], LINE_ORDER)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")


@query
def dedup_collisions(spark, folder):
    return lifecycle.collisions(tables.read(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def union_sources(spark, folder):
    customers = tables.read(spark, folder, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("source"))
    suppliers = tables.read(spark, folder, "supplier").select(F.lit("supplier").alias("source"), F.col("s_name").alias("name"))
    return lifecycle.bag_union([customers, suppliers])


@query
def stage_batch(spark, folder):
    lines = tables.read(spark, folder, "lineitem").select(
        F.year("l_shipdate").cast("long").alias("scrape_run_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        *LINE_ORDER,
    )
    staged = lines.filter(F.col("l_returnflag") == "A")
    fresh = lifecycle.stage_batch(lines, staged, LINE_ORDER)
    return fresh.select("scrape_run_id", "id", "l_partkey", "l_quantity")


def _upserted(spark, folder):
    collected = tables.staging(spark, folder).filter(F.col("scrape_run_id").isin(list(tables.SOURCE_RUNS.values())))
    return lifecycle.promote_upsert(tables.serving(spark, folder), collected)


@query
def promote_upsert(spark, folder):
    return _upserted(spark, folder).select(
        "id", "title", "hackathon_date", "placement", "stack_source", "change",
        F.col("embedding").isNotNull().alias("has_embedding"),
    )


@query
def promote_summary(spark, folder):
    return lifecycle.promote_summary(_upserted(spark, folder))


@query
def hackathon_upsert(spark, folder):
    events = tables.hackathons(spark, folder)
    year = F.year("scraped_at")
    renamed = events.filter(year >= 1999).withColumn("name", F.concat("name", F.lit(" final")))
    late = renamed.withColumn("hackathon_date", F.when(year > 1999, F.col("hackathon_date")))
    moved = late.withColumn("url", F.concat("url", F.lit("/moved")))
    now = F.lit("2002-06-01 00:00:00").cast("timestamp_ntz")
    known = events.filter(year <= 1999).withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
    return lifecycle.hackathon_upsert(known, moved, now)


@query
def promote_events(spark, folder):
    """Events of the store after the gate has promoted the good runs: each stages renamed and moved events from the last imported year on."""
    store = Store(spark, work_folder(spark, "events"))
    events = tables.hackathons(spark, folder).withColumn("year", F.year("scraped_at"))
    now = F.lit("2002-06-01 00:00:00").cast("timestamp")
    known = events.filter(F.col("year") <= tables.LAST_IMPORTED_YEAR)
    projects = tables.stored_projects(spark, folder)
    gate.import_run(store, tables.imported(projects, spark, folder), tables.IMPORT_RUN, ["order_key"], known, now)
    runs = tables.staged(projects).filter(F.col("scrape_run_id") != tables.IMPORT_RUN)
    store.stage(runs.select(*gate.model.STAGING.names))
    seen = events.filter(F.col("year") >= tables.FIRST_STAGED_YEAR).select(
        "source", "slug", F.concat("name", F.lit(" final")).alias("name"),
        F.when(F.col("year") > tables.LAST_IMPORTED_YEAR, F.col("hackathon_date")).alias("hackathon_date"),
        F.concat("url", F.lit("/moved")).alias("url"),
    )
    told = runs.select("scrape_run_id", "source").distinct()
    store.stage_events(seen.join(told, "source"))
    store.log_states([{"run_id": r[0], "seq": 0, "source": r[1], "kind": "scrape", "status": "scraped"} for r in told.collect()])  # a row for each run
    gate.run_gate(store, load_thresholds(), now=now)
    return store.hackathons().drop("scraped_at")


@query
def embed_writeback(spark, folder):
    documents = tables.documents(spark, folder)
    # Texts labelled good were edited after they had been read for encoding.
    encoded = documents.filter(F.col("embedding").isNotNull()).withColumn(
        "title", F.when(F.col("is_winner"), F.concat("title", F.lit(" (old)"))).otherwise(F.col("title"))
    )
    target = documents.withColumn("embedding", F.lit(None).cast("array<float>"))
    stored = lifecycle.embed_writeback(target, encoded)
    return stored.select("id", "written", F.col("embedding").isNotNull().alias("has_embedding"))


# --- enrichment ------------------------------------------------------------------------------


def _merged(spark, folder):
    return enrich.merge_passes(tables.repo_tags(spark, folder), tables.model_tags(spark, folder))


@query
def enrichment_merge(spark, folder):
    return _merged(spark, folder)


@query
def enrichment_apply(spark, folder):
    return enrich.apply_merge(tables.projects(spark, folder), _merged(spark, folder)).select(
        "id", "tech_stack", "stack_source", "theme_tags", "enriched"
    )


@query
def enrichment_summary(spark, folder):
    return enrich.merge_summary(_merged(spark, folder))


@query
def only_missing(spark, folder):
    return catalog.only_missing(tables.projects(spark, folder), tables.model_tags(spark, folder)).select("id", "source")


def _regrounded(spark, folder):
    return enrich.reground(tables.word_claims(spark, folder), tables.documents(spark, folder), tables.WORD_VOCABULARY)


@query
def reground(spark, folder):
    return _regrounded(spark, folder)


@query
def reground_impact(spark, folder):
    return enrich.reground_impact(_regrounded(spark, folder))


@query
def normalize_tags(spark, folder):
    parts = tables.read(spark, folder, "part")
    brand, kind = F.col("p_brand"), F.col("p_type")
    raw = (
        F.when(kind == "PROMO", F.replace(brand, F.lit("Brand#"), F.lit("B")))
        .when(kind == "SMALL", F.concat(F.lit(" \t"), F.upper(brand), F.lit(" ")))
        .when(kind == "LARGE", F.concat(F.lit("x"), brand))
        .otherwise(brand)
    )
    return parts.select("p_partkey", tags.normalize_tag(raw, tables.VOCABULARY).alias("tag"))


@query
def clean_tags(spark, folder):
    rows = tables.projects(spark, folder)
    aliases = F.transform("tech_stack", lambda t: F.replace(t, F.lit("Brand#"), F.lit("B")))
    raw = F.concat(F.reverse("tech_stack"), F.array(F.lit("COBOL"), F.lit("b7")), aliases)
    return rows.select("id", tags.clean_tags(raw, tables.VOCABULARY).alias("tags"))


@query
def clean_themes(spark, folder):
    rows = tables.projects(spark, folder)
    raw = F.concat(
        F.array(F.lit("nope"), F.lit(" Bulk ")), F.transform("theme_tags", lambda t: F.upper(t)), F.array(F.lit("bulk"), F.lit("mini"))
    )
    return rows.select("id", tags.clean_themes(raw, tables.VOCABULARY).alias("themes"))


@query
def parse_tag_json(spark, folder):
    answers = captures.model_answers(spark, folder)
    return answers.select("id", tags.parse_tag_json(F.col("content"), tables.VOCABULARY).alias("t")).select("id", "t.*")


def _manifest_names(spark, folder):
    body = manifests.decode_content(F.col("content"))
    return captures.manifests(spark, folder).select(
        "id", "manifest", "languages", manifests.dependency_names(F.col("manifest"), body).alias("names")
    )


@query
def manifest_deps(spark, folder):
    return _manifest_names(spark, folder).drop("languages")


@query
def tags_from_signals(spark, folder):
    signals = F.concat(F.map_keys("languages"), F.col("names"))
    return _manifest_names(spark, folder).select("id", tags.clean_tags(signals, tables.VOCABULARY).alias("tags"))


# --- scalar functions ------------------------------------------------------------------------


@query
def item_ids(spark, folder):
    customers = tables.read(spark, folder, "customer")
    return customers.select("c_custkey", text.project_id(F.lower("c_mktsegment"), F.col("c_name")).alias("id"))


@query
def clean_text(spark, folder):
    parts = tables.read(spark, folder, "part")
    padded = F.when(F.col("p_type") == "PROMO", F.lit(" \t \n")).otherwise(
        F.concat(F.lit("  \n"), F.col("p_name"), F.lit(" \r\n"))
    )
    return parts.select("p_partkey", text.clean(padded).alias("cleaned"))


@query
def parse_place(spark, folder):
    return captures.raw_prizes(spark, folder).select("item_name", text.parse_place(F.col("item_name")).alias("place"))


@query
def position_map(spark, folder):
    rows = captures.raw_projects(spark, folder)
    return rows.select("id", text.position_outcome(F.col("event_position")).alias("o")).select("id", "o.*")


@query
def best_prize(spark, folder):
    return normalize.best_prizes(captures.raw_prizes(spark, folder))


@query
def normalize_items(spark, folder):
    return normalize.normalize_projects(
        captures.raw_projects(spark, folder),
        captures.raw_events(spark, folder),
        captures.raw_teams(spark, folder),
        captures.raw_prizes(spark, folder),
        captures.FAMILIES,
    )


def _raw_tags(spark, folder):
    ids = captures.raw_projects(spark, folder).filter(F.col("slug") != "").select(
        F.col("id").alias("raw_id"), "source", text.project_id(F.col("source"), F.col("slug")).alias("project_id")
    )
    return normalize.raw_tags(captures.raw_project_tech(spark, folder), captures.raw_technologies(spark, folder), ids)


@query
def raw_tags(spark, folder):
    return _raw_tags(spark, folder)


@query
def raw_tags_load(spark, folder):
    """The store after two imports and a collection. The second import has the tags that begin with a letter up to m, and none of one
    source, which is emptied; the collection brings those with a letter up to e of all sources."""
    store = Store(spark, work_folder(spark, "tags"))
    tags = durable(_raw_tags(spark, folder), "raw-tags")
    store.replace_raw_tags(tags)
    store.replace_raw_tags(tags.filter((F.col("tech_slug") < "n") & (F.col("source") != tables.SOURCES[0])))
    store.add_raw_tags(tags.filter(F.col("tech_slug") < "f"))
    return store.raw_tags().groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("n_projects"))


@query
def excerpt(spark, folder):
    documents = tables.documents(spark, folder)
    cut = text.excerpt(F.col("description"), F.col("short_description"), 600)
    return documents.select("id", cut.alias("e")).select("id", "e.*")


@query
def embed_text(spark, folder):
    documents = tables.documents(spark, folder)
    joined = text.embed_text(F.col("title"), F.col("short_description"), F.col("description"))
    return documents.select("id", F.length(joined).alias("n_chars"), F.md5(joined).alias("text_md5"))


@query
def parse_date_range(spark, folder):
    orders = tables.read(spark, folder, "orders")
    day = F.to_date("o_orderdate")
    spelled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "TBD")
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "MMMM d, yyyy"))
        .otherwise(F.concat(F.date_format(F.date_sub(day, 40), "MMM dd"), F.lit(" - "), F.date_format(day, "MMM dd, yyyy")))
    )
    return orders.select("o_orderkey", text.parse_date_range(spelled).alias("day"))


@query
def parse_iso_date(spark, folder):
    orders = tables.read(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    spelled = F.when(F.col("o_orderstatus") == "P", "not-a-date").otherwise(F.concat(day, F.lit("T00:00:00.000Z")))
    return orders.select("o_orderkey", text.parse_iso_date(spelled).alias("day"))


@query
def url_valid(spark, folder):
    pages_ = tables.read(spark, folder, "pages")
    url = F.when(F.col("url").contains("#top"), F.regexp_replace("url", "//[^/]+", "//")).when(
        F.col("url").contains("page=2"), F.regexp_replace("url", "^https?:", "ftp:")
    ).otherwise(F.col("url"))
    return pages_.select("page_id", text.valid_url(url).alias("valid"), text.url_shaped(url).alias("shaped"))


@query
def parse_repo_url(spark, folder):
    orders = captures.raw_projects(spark, folder)
    url = F.when(F.col("slug") == "", F.lit("https://github.com/shop")).otherwise(
        F.concat("url", F.when(F.col("source") == SOURCE, ".git").otherwise("/tree/main?x=1"))
    )
    return orders.select("id", text.parse_repo_url(url).alias("r")).select("id", "r.owner", "r.repo")


@query
def normalize_vectors(spark, folder):
    """Vectors of one label lose a component and those of another their length: both are refused."""
    rows = tables.read(spark, folder, "embeddings")
    given = (
        F.when(F.col("label") == 0, F.slice("embedding", 1, VECTOR_SIZE - 1))
        .when(F.col("label") == 1, F.transform("embedding", lambda x: x * 0))
        .otherwise(F.transform("embedding", lambda x: x * 3))
    )
    unit = vectors.normalize(given, VECTOR_SIZE)
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", unit.isNotNull().alias("accepted"), F.round(total, 4).alias("total"))


@query
def parse_vectors(spark, folder):
    """Encoder answers: a flat list, one list in a list, one list per token, or not numbers."""
    rows = tables.read(spark, folder, "embeddings")
    flat = F.to_json("embedding")
    answer = (
        F.when(F.col("label") == 0, F.concat(F.lit("["), flat, F.lit("]")))
        .when(F.col("label") == 1, F.concat(F.lit("["), flat, F.lit(","), flat, F.lit("]")))
        .when(F.col("label") == 2, F.replace(flat, F.lit("["), F.lit("[true,")))
        .otherwise(flat)
    )
    unit = vectors.parse_vector(answer, VECTOR_SIZE)
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rows.select("vec_id", unit.isNotNull().alias("accepted"), F.round(total, 4).alias("total"))


# --- export ----------------------------------------------------------------------------------


@query
def export_projects(spark, folder):
    return export.export_projects(tables.serving(spark, folder))


@query
def export_hackathons(spark, folder):
    return export.export_hackathons(tables.hackathons(spark, folder))


@query
def export_embeddings(spark, folder):
    vectors_ = export.export_embeddings(tables.serving(spark, folder))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return vectors_.select("id", F.size("embedding").alias("n"), total.alias("total"))


@query
def export_coverage(spark, folder):
    return export.coverage(export.export_projects(tables.serving(spark, folder)))


# --- payloads and pages ----------------------------------------------------------------------


@query
def json_submissions(spark, folder):
    rows = payloads.submissions(captures.submission_pages(spark, folder), "page")
    return payloads.submission_projects(rows, "lablab", "page")


@query
def json_submissions_tags(spark, folder):
    rows = payloads.submissions(captures.submission_pages(spark, folder), "page")
    return payloads.submission_tags(rows, "lablab")


@query
def json_submissions_events(spark, folder):
    rows = payloads.submissions(captures.submission_pages(spark, folder), "page")
    return payloads.submission_events(payloads.submission_projects(rows, "lablab", "page"), "page", "ord")


@query
def json_event_list(spark, folder):
    return payloads.event_list(captures.event_list_pages(spark, folder), "source", "year")


@query
def json_event_list_meta(spark, folder):
    return payloads.event_list_meta(captures.event_list_pages(spark, folder), "source", "year")


@query
def page_details(spark, folder):
    return pages.software_details(captures.software_pages(spark, folder), "id")


@query
def page_entries(spark, folder):
    return pages.gallery_entries(captures.gallery_pages(spark, folder), "page")


@query
def page_outlines(spark, folder):
    captured = tables.read(spark, folder, "pages").withColumnRenamed("html", "body")
    return pages.page_outlines(captured, "page_id")


@query
def script_listing(spark, folder):
    return payloads.listing_entries(captures.listing_pages(spark, folder), "page")


@query
def script_payloads(spark, folder):
    return payloads.script_projects(captures.script_pages(spark, folder), "id")


@query
def page_block_flags(spark, folder):
    return pages.block_flags(captures.responses(spark, folder)).select("page_id", "status", "blocked", "marker", "note")


@query
def redact_pages(spark, folder):
    captured = captures.pages_with_credentials(spark, folder)
    clean = pages.redact(F.col("body"))
    return captured.select(
        "page_id",
        pages.has_residue(F.col("body")).alias("residue_before"),
        pages.has_residue(clean).alias("residue_after"),
        F.md5(clean).alias("body_md5"),
    )


# --- streams ---------------------------------------------------------------------------------


def _deliveries(spark, folder, work):
    """Staged runs, dealt over two folders as they arrive one after the other, with the tasks that the rows already have."""
    rows = tables.staged(tables.stored_projects(spark, folder)).filter(F.col("scrape_run_id") != tables.IMPORT_RUN)
    rows = rows.select(*gate.model.STAGING.names)
    half = F.pmod(F.xxhash64("id"), F.lit(2))

    def arrive(part: int) -> None:
        rows.filter(half == part).write.mode("append").parquet(f"{work}/incoming", compression="zstd")

    return rows, arrive


@query
def stream_gate(spark, folder):
    work = work_folder(spark, "gate")
    store = Store(spark, f"{work}/store")
    gate.import_run(store, tables.imported(tables.stored_projects(spark, folder), spark, folder), tables.IMPORT_RUN, ["order_key"])
    rows, arrive = _deliveries(spark, folder, work)
    told = lifecycle.distinct_of_few(rows.select("scrape_run_id", "source", "id")).groupBy("scrape_run_id", "source")
    for run in told.agg(F.count("id").alias("n")).collect():  # one row for each run
        gate.finish_run(store, run.scrape_run_id, run.source, run.n)
    for part in (0, 1):
        arrive(part)
        gate.stream_gate(spark, f"{work}/incoming", store, load_thresholds(), f"{work}/progress").awaitTermination()
    status = quality.run_status(store.events())
    served = store.serving().groupBy("source").agg(F.count("*").alias("n_serving"))
    return status.join(served, "source", "left").select("run_id", "status", "n_scraped", "n_promoted", "n_serving")


@query
def stream_dedup(spark, folder):
    work = work_folder(spark, "dedup")
    _, arrive = _deliveries(spark, folder, work)
    for part in (0, 1):
        arrive(part)
    gate.stream_dedup(spark, f"{work}/incoming", f"{work}/unique", f"{work}/progress").awaitTermination()
    return spark.read.parquet(f"{work}/unique").groupBy("source").agg(F.count("*").alias("n"))
