"""Captured payloads and relational dumps derived from the given tables.

Spark writes the payloads from the tables, one per page of the source, so their number grows with
the data and a page stays small. Parsing them must give the table values back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables

PAGE_SIZE = 50
FAMILIES = {
    "position": ["automobile", "building"],
    "winners_only": ["furniture"],
    "prizes": ["household", "machinery"],
}


def _position() -> Column:
    """Declared position of an order, from its priority."""
    names = {
        "1-URGENT": "WINNERS",
        "2-HIGH": "TOP_2",
        "3-MEDIUM": "TOP_3",
        "4-NOT SPECIFIED": "FINALISTS",
    }
    position = F.lit("OTHER")
    for priority, name in names.items():
        position = F.when(F.col("o_orderpriority") == priority, name).otherwise(position)
    return position


def _slug() -> Column:
    return F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))


def _page(key: str) -> Column:
    return F.floor(F.col(key) / PAGE_SIZE)


# --- relational dumps ------------------------------------------------------------------------


@tables.view
def raw_projects(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.dated_orders(spark, folder)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(_slug()).alias("slug"),
        F.when(F.col("c_acctbal") < 0, None)
        .when(F.col("c_acctbal") < 5000, F.concat(F.lit(" https://github.com/shop/"), _slug()))
        .otherwise(F.concat(F.lit("https://shop.example/"), _slug()))
        .alias("url"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t")).alias("short_description"),
        F.when(F.col("o_orderstatus") == "P", "   ")
        .otherwise(F.concat(F.lit("Ordered by "), F.col("c_name")))
        .alias("description"),
        _position().alias("event_position"),
        F.col("c_nationkey").alias("event_id"),
        F.col("o_custkey").alias("team_id"),
        F.lower("c_mktsegment").alias("source"),
    )


@tables.view
def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the regions that have a dump; projects of the others are dropped."""
    nations = tables.read(spark, folder, "nation").filter(F.col("n_regionkey") > 0)
    return nations.select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug")
    )


@tables.view
def raw_teams(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )


@tables.view
def raw_prizes(spark: SparkSession, folder: str) -> DataFrame:
    """Prizes are the returned lines; the first three line numbers name a place."""
    line = F.col("l_linenumber")
    suffix = F.when(line == 1, "1st").when(line == 2, "2nd").when(line == 3, "3rd")
    ord_columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return (
        tables.order_lines(spark, folder)
        .filter(F.col("l_returnflag") == "R")
        .select(
            F.col("l_orderkey").alias("project_id"),
            F.when(suffix.isNotNull(), F.concat(F.lit("Best "), F.col("p_type"), F.lit(" - "), suffix, F.lit(" Place")))
            .otherwise(F.concat(F.lit("Pool "), F.col("p_type")))
            .alias("item_name"),
            F.when(F.col("l_discount") > 0, F.concat(F.lit(" "), F.col("p_name"))).alias("prize_name"),
            F.struct(*ord_columns).alias("ord"),
        )
    )


@tables.view
def raw_technologies(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "part").select(
        F.col("p_partkey").alias("tech_id"),
        F.col("p_brand").alias("tech_name"),
        F.lower("p_type").alias("tech_slug"),
    )


@tables.view
def raw_project_tech(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("raw_id"), F.col("l_partkey").alias("tech_id"), F.col("l_linenumber").alias("position")
    )


# --- JSON payloads ---------------------------------------------------------------------------


@tables.view
def submission_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Submission pages of 50 orders. Odd pages are bare lists, as an archive may be."""
    orders = tables.dated_orders(spark, folder)
    submission = F.struct(
        F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(_slug()).alias("slug"),
        F.col("o_orderpriority").alias("shortDescription"),
        F.concat(F.lit("Ordered by \""), F.col("c_name"), F.lit("\"\n")).alias("description"),
        _position().alias("eventPosition"),
        F.struct(F.col("n_name").alias("name"), F.lower("n_name").alias("slug")).alias("event"),
        F.struct(F.col("c_name").alias("name"), F.lit("t").alias("slug")).alias("team"),
        F.array(
            F.struct(F.struct(F.col("o_orderstatus").alias("name"), F.lit("s").alias("slug")).alias("tech")),
            F.struct(F.struct(F.col("c_mktsegment").alias("name"), F.lit("m").alias("slug")).alias("tech")),
            F.struct(F.struct(F.lit(" ").alias("name"), F.lit("none").alias("slug")).alias("tech")),
        ).alias("techIn"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("https://video.example/"), _slug())).alias("videoLink"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("o_orderkey", submission.alias("s")))), lambda x: x.s
    )
    pages = orders.groupBy(_page("o_orderkey").alias("page")).agg(listed.alias("submissions"))
    wrapped = F.to_json(F.struct("submissions", F.col("page").cast("string").alias("nextCursor")))
    body = F.when(F.col("page") % 2 == 1, F.to_json("submissions")).otherwise(wrapped)
    return pages.select("page", body.alias("body"))


@tables.view
def event_list_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Event lists of each source and year, as the site's JSON."""
    events = tables.hackathons(spark, folder).withColumn("year", F.year("scraped_at"))
    day = F.col("hackathon_date")
    event = F.struct(
        F.col("name").alias("title"),
        F.when(F.col("source") == "furniture", F.lit("https://elsewhere.example/x"))
        .otherwise(F.concat(F.lit("https://"), F.col("slug"), F.lit(".devpost.com/")))
        .alias("url"),
        F.coalesce(
            F.concat(F.lit("Jan 01 - "), F.date_format(day, "MMM dd, yyyy")), F.lit("TBD")
        ).alias("submission_period_dates"),
        day.isNotNull().alias("winners_announced"),
    )
    listed = F.array_sort(F.collect_list(event)).alias("hackathons")
    pages = events.groupBy("source", "year").agg(listed)
    meta = F.struct(F.size("hackathons").alias("total_count"), F.lit(50).alias("per_page")).alias("meta")
    return pages.select("source", "year", F.to_json(F.struct("hackathons", meta)).alias("body"))


@tables.view
def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of a tag model: brands by alias, unknown words, and some broken JSON."""
    rows = tables.projects(spark, folder)
    aliased = F.transform("tech_stack", lambda t: F.replace(F.lower(t), F.lit("brand#"), F.lit("b")))
    answer = F.to_json(
        F.struct(
            F.concat(aliased, F.array(F.lit("COBOL-9"))).alias("tech_stack"),
            F.transform("theme_tags", lambda t: F.upper(t)).alias("theme_tags"),
        )
    )
    content = (
        F.when(F.col("raw_placement") == "1-URGENT", "not json")
        .when(F.col("raw_placement") == "2-HIGH", '{"tech_stack": "b1", "theme_tags": ["PROMO", "x"]}')
        .otherwise(answer)
    )
    return rows.select("id", content.alias("content"))


@tables.view
def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One build manifest per project, in a format by priority, that declares its brands."""
    rows = tables.projects(spark, folder)
    names = F.transform("tech_stack", lambda t: F.replace(F.lower(t), F.lit("brand#"), F.lit("b")))

    def lines(before: str, after: str) -> Column:
        return F.array_join(F.transform(names, lambda n: F.concat(F.lit(before), n, F.lit(after))), "\n")

    formats = {
        "1-URGENT": ("requirements.txt", F.concat(F.lit("# tools\n-r base.txt\n"), lines("", ">=1.0"))),
        "2-HIGH": ("go.mod", F.concat(F.lit("module shop\n\nrequire (\n"), lines("\tgithub.com/shop/", " v1.2.3"), F.lit("\n)"))),
        "3-MEDIUM": ("Cargo.toml", F.concat(F.lit("[dependencies]\n"), lines("", ' = "1"'))),
        "4-NOT SPECIFIED": (
            "pyproject.toml",
            F.concat(F.lit("[tool.poetry.dependencies]\npython = \"^3.12\"\n"), lines("", ' = "*"')),
        ),
        "5-LOW": (
            "package.json",
            F.to_json(
                F.struct(F.map_from_arrays(names, F.transform(names, lambda n: F.lit("^1"))).alias("dependencies"))
            ),
        ),
    }
    manifest, body = F.lit(None).cast("string"), F.lit(None).cast("string")
    for priority, (name, content) in formats.items():
        manifest = F.when(F.col("raw_placement") == priority, name).otherwise(manifest)
        body = F.when(F.col("raw_placement") == priority, content).otherwise(body)
    languages = F.when(F.col("is_winner"), F.create_map(F.lit("B25"), F.lit(900), F.lit("Fortran"), F.lit(10)))
    return rows.select(
        "id",
        manifest.alias("manifest"),
        F.base64(F.encode(body, "UTF-8")).alias("content"),
        F.coalesce(languages, F.create_map().cast("map<string,int>")).alias("languages"),
    )


# --- pages -----------------------------------------------------------------------------------


@tables.view
def software_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A project page per project: description, links and declared tags."""
    rows = tables.projects(spark, folder)
    link = lambda url: F.coalesce(F.concat(F.lit('<li><a href="'), url, F.lit('">Try</a></li>')), F.lit(""))
    tags = F.array_join(
        F.transform("tech_stack", lambda t: F.concat(F.lit('<li><span class="cp-tag"> '), t, F.lit("</span></li>"))), ""
    )
    text = F.coalesce(
        F.concat(F.lit('<div id="app-details-left"><h2>About</h2><p>'), "description", F.lit("</p></div>")), F.lit("")
    )
    body = F.concat(
        F.lit("<html><head><title>"), "title", F.lit('</title><meta name="description" content="Page of '), "title",
        F.lit('"></head><body>'), text, F.lit('<nav class="app-links"><ul><li><a href="#top">top</a></li>'),
        link(F.col("repo_url")), link(F.lower("demo_url")), F.lit('</ul></nav><div id="built-with"><ul>'), tags,
        F.lit("</ul></div></body></html>"),
    )
    return rows.select("id", body.alias("body"))


@tables.view
def gallery_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Gallery pages of 50 orders; winners carry a ribbon."""
    orders = tables.dated_orders(spark, folder)
    won = F.col("o_orderstatus") == "F"
    entry = F.concat(
        F.lit('<div class="gallery-item" data-software-id="'), F.col("o_orderkey").cast("string"),
        F.lit('"><a class="block link-to-software" href="https://shop.example/software/'), _slug(),
        F.lit('?ref=1"><h5> Order '), F.col("o_orderkey").cast("string"), F.lit(' </h5><p class="tagline">'),
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")), F.lit("</p></a>"),
        F.when(won, F.concat(F.lit('<aside class="entry-badge"><img class="winner" src="r.png"> Winner '),
                             F.col("o_orderpriority"), F.lit("</aside>"))).otherwise(""),
        F.lit('<div class="members"><img alt="'), "c_name", F.lit('"><img alt="'), "n_name",
        F.lit('"><img alt="'), "c_name", F.lit('"></div></div>'),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x.e
    )
    pages = orders.groupBy(_page("o_orderkey").alias("page")).agg(F.array_join(listed, "").alias("b"))
    return pages.select("page", F.concat(F.lit("<html><body>"), "b", F.lit("</body></html>")).alias("body"))


def _pushed(payload: Column) -> Column:
    """A script call that pushes a text, escaped as a JSON string."""
    quoted = F.to_json(F.struct(payload.alias("t")))
    inner = F.substring(quoted, F.lit(7), F.length(quoted) - 8)
    return F.concat(F.lit('<script>self.__next_f.push([1,"'), inner, F.lit('"])</script>'))


@tables.view
def script_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A project page per project with its record inside script calls; long descriptions are
    references to a payload of their own."""
    rows = tables.projects(spark, folder)
    prize = F.struct(
        F.concat(F.col("raw_placement"), F.lit(": 2nd place")).alias("name"),
        F.struct(F.col("prize_track").alias("name")).alias("prize"),
    )
    by_reference = F.length("description") > 80
    record = F.to_json(
        F.struct(
            F.substring("id", 1, 10).alias("uuid"),
            F.concat(F.lit("order-"), F.col("order_key").cast("string")).alias("slug"),
            F.col("title").alias("name"),
            F.concat(F.lit('"'), F.col("team_name"), F.lit('" é')).alias("tagline"),
            F.when(by_reference, "$28").otherwise(F.col("description")).alias("description"),
            F.col("repo_url").alias("sourceCodeUrl"),
            F.struct(
                F.col("hackathon_slug").alias("slug"),
                F.col("hackathon_name").alias("name"),
                F.concat(F.col("hackathon_date").cast("string"), F.lit("T00:00:00.000Z")).alias("startTime"),
            ).alias("event"),
            F.when(F.col("is_winner"), F.array(prize)).otherwise(F.array().cast("array<struct<name:string,prize:struct<name:string>>>")).alias("prizes"),
        )
    )
    body = F.concat(
        F.lit("<html><body>"), _pushed(F.concat(F.lit('0:["$","main",null,{"project":'), record, F.lit("}]"))),
        F.coalesce(F.when(by_reference, _pushed(F.concat(F.lit("28:T1f4,"), "description"))), F.lit("")),
        F.lit("</body></html>"),
    )
    return rows.select("id", body.alias("body"))


@tables.view
def responses(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages as fetched responses. Some addresses answer with a challenge or a refusal."""
    pages = tables.read(spark, folder, "pages")
    url = F.col("url")
    return pages.select(
        "page_id",
        "url",
        F.when(url.contains("#top"), 403).when(url.contains("page=2"), 503).otherwise(200).alias("status"),
        F.when(
            url.contains("page=2"), F.concat(F.lit("<title>Just a Moment...</title>"), "html")
        ).when(url.contains("/de/"), F.concat("html", F.lit('<script src="/cdn-cgi/challenge-platform/h"></script>')))
        .otherwise(F.col("html"))
        .alias("body"),
    )


@tables.view
def pages_with_credentials(spark: SparkSession, folder: str) -> DataFrame:
    """The given pages with meta tags that must not be kept."""
    pages = tables.read(spark, folder, "pages")
    meta = F.concat(
        F.lit('<meta name="maps-api-key" content="KEY'), F.col("page_id").cast("string"),
        F.lit('"><meta property="og:description" content="'), F.translate("url", '"', ""), F.lit('">'),
    )
    return pages.select("page_id", "url", F.concat(meta, F.col("html")).alias("body"))


@tables.view
def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Listing pages of 50 orders inside script calls; winners have a prize."""
    orders = tables.dated_orders(spark, folder)
    prize = F.struct(F.lit("1st place").alias("name"), F.struct(F.lit("Main").alias("name")).alias("prize"))
    nothing = F.array().cast("array<struct<name:string,prize:struct<name:string>>>")
    entry = F.struct(
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("uuid"),
        _slug().alias("slug"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("tagline"),
        F.when(F.col("o_orderstatus") == "F", F.array(prize)).otherwise(nothing).alias("prizes"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x.e
    )
    pages = orders.groupBy(_page("o_orderkey").alias("page")).agg(listed.alias("projects"))
    payload = F.concat(F.lit('3:["$",{"projects":'), F.to_json("projects"), F.lit(',"total":9}]'))
    return pages.select(
        "page", F.concat(F.lit("<html>"), _pushed(F.lit("1:T4,none")), _pushed(payload), F.lit("</html>")).alias("body")
    )
