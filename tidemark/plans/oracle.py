"""The SQL that each registered query is compared with, for DuckDB over the same tables.

Statements share the catalogue views as common table expressions. Each states the expected result from
the given tables; payload and page queries are checked against the values the payloads were made of.
"""

from __future__ import annotations

from tidemark.config import load_thresholds
from tidemark.operators import search
from tidemark.plans.registry import (
    EXCLUDING_TEXT,
    QUERY_DOCUMENT,
    RELAXED_TEXT,
    SEARCH_TEXT,
    SLUG,
    SOURCE,
    THEME,
    VECTOR_SIZE,
)
from tidemark.sources import captures, pages, tables

SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _clean(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g'), '')"


def _day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _joined(c: str) -> str:
    return f"array_to_string({c}, '|')"


def _r(c: str) -> str:
    return f"round({c}, 6) + 0.0"


SUMMARY = f"""id, source, source_url, title, placement, raw_placement, is_winner, prize_track, team_name,
    {_joined('tech_stack')} AS tech_stack, repo_url, demo_url"""
BOARD = "is_winner DESC, placement ASC NULLS LAST, title ASC, id ASC"
BIAS = "win rates depend on the number of prizes and on how winners were collected"

_run_of = " ".join(f"WHEN '{s}' THEN {r}" for s, r in tables.SOURCE_RUNS.items())

# Shared views, each with the views it needs.
VIEWS: dict[str, tuple[list[str], str]] = {
    "tags": (
        [],
        """SELECT l_orderkey AS tag_orderkey,
        list_sort(list(DISTINCT p_brand)) AS brands,
        list_sort(list(DISTINCT lower(p_type))) AS types,
        list_sort(list(DISTINCT p_name)) AS part_names,
        list_sort(coalesce(list(DISTINCT p_brand) FILTER (WHERE l_returnflag = 'A'), [])) AS claimed,
        list_sort(coalesce(list(DISTINCT p_brand) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.05), [])) AS returned,
        bool_or(l_returnflag = 'R') AS has_return, max(l_linenumber) AS last_line
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    ),
    "dated": (
        [],
        """SELECT *, lower(c_mktsegment) AS source, 'order-' || o_orderkey AS slug, year(o_orderdate) AS yr
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "items": (
        ["tags", "dated"],
        """SELECT sha256(source || ':' || slug) AS id, source,
        'https://' || source || '.example/p/' || slug AS source_url,
        lower(n_name) || '-' || yr AS hackathon_slug, n_name || ' ' || yr AS hackathon_name,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS hackathon_date,
        coalesce(types, [])[1:3] AS theme_tags, 'Order ' || o_orderkey AS title,
        'Made of ' || array_to_string(part_names, ', ') AS description,
        CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority || ' order of ' || c_name END AS short_description,
        CASE WHEN o_orderstatus = 'F' AND CAST(o_orderpriority[1:1] AS INT) <= 3
             THEN CAST(o_orderpriority[1:1] AS INT) END AS placement,
        o_orderpriority AS raw_placement, o_orderstatus = 'F' AS is_winner,
        CASE WHEN o_orderstatus = 'F' THEN part_names[-1] END AS prize_track,
        coalesce(brands, []) AS tech_stack,
        CASE WHEN has_return THEN 'github' WHEN len(coalesce(brands, [])) > 0 THEN 'llm' ELSE 'none' END AS stack_source,
        last_line AS team_size, c_name AS team_name,
        CASE WHEN has_return THEN 'https://github.com/shop/' || slug END AS repo_url,
        CASE WHEN c_acctbal < 0 THEN 'demo/' || slug WHEN c_acctbal < 8000 THEN 'HTTP://demo.example/' || slug END AS demo_url,
        CAST(o_orderdate AS TIMESTAMP) AS scraped_at, o_orderkey AS order_key, yr AS order_year,
        coalesce(claimed, []) AS claimed, coalesce(returned, []) AS returned
        FROM dated LEFT JOIN tags ON o_orderkey = tag_orderkey""",
    ),
    "hackathons": (
        ["dated"],
        """SELECT source, lower(n_name) || '-' || yr AS slug, n_name || ' ' || yr AS name, max(day) AS hackathon_date,
        'https://' || source || '.example/e/' || lower(n_name) || '-' || yr AS url, make_timestamp(yr, 12, 31, 0, 0, 0) AS scraped_at, yr
        FROM (SELECT source, n_name, yr, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM dated
              UNION ALL SELECT lower(c_mktsegment), n_name, 2002, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey)
        GROUP BY source, n_name, yr""",
    ),
    "serving": (
        ["items"],
        f"""SELECT items.*, embedding FROM items LEFT JOIN embeddings ON vec_id = order_key
        WHERE order_year <= {tables.LAST_IMPORTED_YEAR}""",
    ),
    "staging": (
        ["items"],
        f"""SELECT * REPLACE (CASE WHEN run <> 1 AND raw_placement = '2-HIGH' THEN title || ' v2' ELSE title END AS title,
            CASE WHEN run <> {tables.BROKEN_RUN} THEN description END AS description,
            CASE WHEN run <> {tables.BROKEN_RUN} THEN repo_url END AS repo_url), run AS scrape_run_id
        FROM (SELECT *, 1 AS run FROM items WHERE order_year <= {tables.LAST_IMPORTED_YEAR}
              UNION ALL SELECT *, CASE source {_run_of} END FROM items WHERE order_year >= {tables.FIRST_STAGED_YEAR}
              UNION ALL SELECT *, {tables.BROKEN_RUN} FROM items
                        WHERE order_year >= {tables.FIRST_STAGED_YEAR} AND source = '{tables.SOURCES[0]}')""",
    ),
    "runs": (
        ["staging"],
        f"""SELECT scrape_run_id AS run_id, count(*) AS n_scraped,
        CASE WHEN scrape_run_id > 1 THEN min(source) END AS source,
        CASE WHEN scrape_run_id = 1 THEN 'import' ELSE 'scrape' END AS kind,
        CASE WHEN scrape_run_id = 1 THEN 'promoted' WHEN scrape_run_id = {tables.SOURCE_RUNS['machinery']} THEN 'validated'
             ELSE 'scraped' END AS status
        FROM staging GROUP BY scrape_run_id""",
    ),
    "docs": (
        [],
        """SELECT d.doc_id AS id, d.source, d.lang, string_split(text, chr(10))[1] AS title,
        string_split(text, chr(10))[2] AS short_description, text AS description, embedding, coalesce(quality, 0) = 1 AS is_winner
        FROM documents d LEFT JOIN embeddings ON d.doc_id = vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "themes": (
        [],
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{t.slug}', '{t.label}', '{t.description}')" for t in tables.VOCABULARY.themes)
        + ") v(slug, label, description)",
    ),
    "theme_n": (
        ["items"],
        """SELECT slug, count(*) AS project_count, count(*) FILTER (WHERE is_winner) AS winner_count
        FROM (SELECT unnest(theme_tags) AS slug, is_winner FROM items) GROUP BY slug""",
    ),
}


def _with(*names: str, body: str, **extra: str) -> str:
    """``body`` with the named views and everything they need in front."""
    ordered: dict[str, str] = {}

    def need(name: str) -> None:
        before, sql = VIEWS[name]
        for other in before:
            need(other)
        ordered.setdefault(name, sql)

    for name in names:
        need(name)
    ordered.update(extra)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in ordered.items()) + "\n" + body


# --- search ----------------------------------------------------------------------------------


def _word_lists() -> str:
    fields = ", ".join(
        rf"regexp_extract_all(lower(coalesce({f}, '')), '[\p{{L}}\p{{N}}]+') AS w_{f}" for f in search.FIELD_WEIGHTS
    )
    return f"SELECT id, {fields} FROM docs"


def _count(field: str, term: search.Term) -> str:
    words = f"w_{field}"
    if len(term) == 1:
        return f"len(list_filter({words}, lambda w: w = '{term[0]}'))"
    follows = " AND ".join(f"{words}[i + {k}] = '{w}'" for k, w in enumerate(term) if w is not None)
    return f"len(list_filter(generate_series(1, len({words})), lambda i: {follows}))"


def _lexical(typed: str, k: int = search.CANDIDATES, name: str = "lexical", scope: str = "true") -> dict[str, str]:
    query = search.parse_query(typed)
    asked = query.terms + query.excluded
    counts = ", ".join(f"{_count(f, t)} AS n_{f}_{i}" for i, t in enumerate(asked) for f in search.FIELD_WEIGHTS)
    total = {t: "(" + " + ".join(f"n_{f}_{i}" for f in search.FIELD_WEIGHTS) + ")" for i, t in enumerate(asked)}
    rank = " + ".join(f"{w}::DOUBLE * n_{f}_{i}" for i, _ in enumerate(query.terms) for f, w in search.FIELD_WEIGHTS.items())
    strict = " OR ".join("(" + " AND ".join(f"{total[t]} > 0" for t in g) + ")" for g in query.alternatives)
    none_of = "".join(f" AND {total[t]} = 0" for t in query.excluded)
    candidate = " OR ".join(f"{total[t]} > 0" for t in query.terms) if query.can_relax else strict
    return {
        "words": _word_lists(),
        "counted": f"SELECT id, {counts} FROM words WHERE id IN (SELECT id FROM docs WHERE {scope})",
        "matched": f"SELECT id, ({strict}) AS strict, {rank} AS lexical_rank FROM counted WHERE ({candidate}){none_of}",
        name: f"""SELECT id, lexical_rank, row_number() OVER (ORDER BY lexical_rank DESC, id) AS rank FROM matched
        WHERE strict OR NOT EXISTS (SELECT 1 FROM matched WHERE strict)
        QUALIFY rank <= {k}""",
    }


def _nearest(k: int = search.CANDIDATES, scope: str = "true", others: bool = False) -> dict[str, str]:
    vector = f"(SELECT embedding FROM docs WHERE id = {QUERY_DOCUMENT})::DOUBLE[]"
    skip = f"AND id <> {QUERY_DOCUMENT}" if others else ""
    return {
        "nearest": f"""SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM (
        SELECT id, list_cosine_distance(embedding::DOUBLE[], {vector}) AS distance
        FROM docs WHERE embedding IS NOT NULL AND ({scope}) {skip}) QUALIFY rank <= {k}"""
    }


def _excerpt(n: int = 600) -> str:
    whole = f"coalesce({_clean('description')}, {_clean('short_description')})"
    return f"""SELECT id, CASE WHEN length(w) > {n} THEN regexp_replace(
        CASE WHEN length(head) - tail - 1 > {n // 2} THEN head[1:length(head) - tail - 1] ELSE head END, '{SPACE}+$', '') || '…'
        ELSE w END AS text, coalesce(length(w) > {n}, false) AS truncated
        FROM (SELECT *, CASE WHEN contains(head, ' ') THEN length(regexp_extract(head, '[^ ]*$')) ELSE length(head) END AS tail
              FROM (SELECT id, {whole} AS w, ({whole})[1:{n}] AS head FROM docs))"""


def _hybrid(with_vector: bool = True, scope: str = "true") -> str:
    arms = _lexical(SEARCH_TEXT, scope=scope)
    arms |= _nearest(scope=scope if with_vector else "false")
    arms["fused"] = f"""SELECT coalesce(n.id, l.id) AS id,
        coalesce(1e0 / ({search.RRF_K} + n.rank), 0) + coalesce(1e0 / ({search.RRF_K} + l.rank), 0) AS score
        FROM nearest n FULL OUTER JOIN lexical l ON n.id = l.id"""
    arms["top"] = "SELECT * FROM fused ORDER BY score DESC, id LIMIT 20"
    arms["cut"] = _excerpt()
    return _with(
        "docs",
        body=f"""SELECT d.id, source, title, is_winner, c.text AS excerpt, c.truncated AS excerpt_truncated,
        {_r('score')} AS score FROM top JOIN docs d ON d.id = top.id JOIN cut c ON c.id = top.id""",
        **arms,
    )


# --- quality gate ----------------------------------------------------------------------------


def _metrics(source: str, keys: str) -> str:
    fills = ", ".join(f"avg(({c} IS NOT NULL)::INT) AS fill_{c}" for c in
                      ("description", "hackathon_date", "repo_url", "demo_url", "prize_track", "placement"))
    urls = ("source_url", "repo_url", "demo_url")
    given = " + ".join(f"({u} IS NOT NULL)::INT" for u in urls)
    formed = " + ".join(f"coalesce(regexp_matches({u}, '(?i)^https?://.'), false)::INT" for u in urls)
    return f"""SELECT {keys}, count(*) AS n, {fills},
        coalesce(quantile_cont(length(description), 0.5), 0.0) AS median_desc_len,
        coalesce(sum({formed}) / nullif(sum({given}), 0), 0.0) AS url_valid_rate
        FROM {source} GROUP BY {keys}"""


def _events(source: str, keys: str) -> str:
    return f"SELECT {keys}, hackathon_slug, count(*) AS n FROM {source} GROUP BY {keys}, hackathon_slug"


def _check_ctes(first_time: bool = False) -> dict[str, str]:
    limits = load_thresholds()
    anchor = "NULL::BIGINT" if first_time else (
        "(SELECT min(s.scrape_run_id) FROM staging s JOIN runs p ON p.run_id = s.scrape_run_id "
        "WHERE p.status = 'promoted' AND s.source = runs.source)"
    )
    base = "(SELECT * FROM serving WHERE false)" if first_time else "serving"
    ctes = {
        "pending": f"""SELECT run_id, source, {anchor} AS anchor_run FROM runs
        WHERE status IN ('scraped', 'validated') AND source IS NOT NULL""",
        "staged": _metrics("staging", "scrape_run_id, source"),
        "staged_ev": _events("staging", "scrape_run_id, source"),
        "moving_m": f"SELECT run_id, m.* FROM pending p JOIN ({_metrics(base, 'source')}) m ON m.source = p.source",
        "anchor_m": """SELECT run_id, m.* FROM pending p JOIN staged m
        ON m.source = p.source AND m.scrape_run_id = p.anchor_run""",
        "moving_o": f"""SELECT p.run_id, count(*) AS overlap, sum(b.n) AS base, sum(c.n) AS cand FROM pending p
        JOIN staged_ev c ON c.scrape_run_id = p.run_id AND c.source = p.source
        JOIN ({_events(base, 'source')}) b ON b.source = c.source AND b.hackathon_slug = c.hackathon_slug GROUP BY p.run_id""",
        "anchor_o": """SELECT p.run_id, count(*) AS overlap, sum(b.n) AS base, sum(c.n) AS cand FROM pending p
        JOIN staged_ev c ON c.scrape_run_id = p.run_id AND c.source = p.source
        JOIN staged_ev b ON b.scrape_run_id = p.anchor_run AND b.source = c.source AND b.hackathon_slug = c.hackathon_slug
        GROUP BY p.run_id""",
    }
    rows = []
    for profile, rules in limits.profiles.items():
        for rule in rules:
            name = f"{profile}:{rule.metric}"
            if rule.mode == "overlap":
                rows.append(
                    f"""SELECT p.run_id, '{name}' AS check_name, 'overlap' AS mode, o.base::DOUBLE AS baseline,
                    o.cand::DOUBLE AS candidate, {rule.limit}::DOUBLE AS "limit", coalesce(o.overlap, 0) AS overlap
                    FROM pending p JOIN {profile}_m b ON b.run_id = p.run_id LEFT JOIN {profile}_o o ON o.run_id = p.run_id"""
                )
                continue
            column = {"median_desc_len": "median_desc_len", "placement_fill": "fill_placement"}.get(
                rule.metric, "fill_" + rule.metric.removeprefix("null_rate.")
            )
            rows.append(
                f"""SELECT p.run_id, '{name}' AS check_name, '{rule.mode}' AS mode, b.{column} AS baseline,
                c.{column} AS candidate, {rule.limit}::DOUBLE AS "limit", NULL::BIGINT AS overlap
                FROM pending p JOIN {profile}_m b ON b.run_id = p.run_id
                JOIN staged c ON c.scrape_run_id = p.run_id AND c.source = p.source"""
            )
        rows.append(
            f"""SELECT run_id, '{profile}:bootstrap', 'bootstrap', NULL, NULL, NULL, NULL FROM pending
            WHERE run_id NOT IN (SELECT run_id FROM {profile}_m)"""
        )
    rows.append(
        f"""SELECT p.run_id, 'batch:url_valid', 'rate', NULL, c.url_valid_rate, {limits.url_valid_min_rate}::DOUBLE, NULL
        FROM pending p JOIN staged c ON c.scrape_run_id = p.run_id AND c.source = p.source"""
    )
    ctes["raw_checks"] = "\nUNION ALL ".join(rows)
    ctes["judged"] = """SELECT *, CASE mode WHEN 'absolute' THEN (baseline - candidate) * 100
        WHEN 'relative' THEN (baseline - candidate) / nullif(baseline, 0) * 100
        WHEN 'overlap' THEN (baseline - candidate) / nullif(baseline, 0) * 100 END AS "drop",
        CASE WHEN mode = 'bootstrap' THEN 'no_baseline' WHEN overlap = 0 THEN 'no_overlap'
             WHEN mode IN ('relative', 'overlap') AND baseline = 0 THEN 'baseline_zero_pass' END AS note FROM raw_checks"""
    ctes["checks"] = """SELECT p.run_id AS scrape_run_id, p.source, j.* EXCLUDE (run_id),
        CASE WHEN note IS NOT NULL THEN true WHEN mode = 'rate' THEN candidate >= "limit"
             ELSE "drop" <= "limit" END AS passed FROM judged j JOIN pending p ON p.run_id = j.run_id"""
    return ctes


def _checks(body: str, first_time: bool = False, more: tuple[str, ...] = ()) -> str:
    return _with("serving", "staging", "runs", *more, body=body, **_check_ctes(first_time))


_FAILED = "coalesce(string_agg(check_name, ', ' ORDER BY check_name) FILTER (WHERE NOT passed), '')"


def _report() -> str:
    order = []
    for profile, rules in load_thresholds().profiles.items():
        order += [f"{profile}:{r.metric}" for r in rules] + [f"{profile}:bootstrap"]
    order.append("batch:url_valid")
    place = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(order))

    def shown(c: str) -> str:
        return f"coalesce(printf('%.2f', round_even({c}, 2)), '-')"

    line = f"""'| `' || check_name || '` | ' || {shown('baseline')} || ' | ' || {shown('candidate')} || ' | ' ||
        coalesce(note, {shown('"drop"')}) || ' | ' || {shown('"limit"')} || ' | ' || CASE WHEN passed THEN 'pass' ELSE 'FAIL' END || ' |'"""
    return f"""SELECT scrape_run_id, source, bool_and(passed) AS passed,
        '## run ' || scrape_run_id || ', source `' || source || '`: ' ||
        CASE WHEN bool_and(passed) THEN 'accepted' ELSE 'REJECTED, the serving table is unchanged' END || chr(10) || chr(10) ||
        '| check | baseline | batch | drop | limit | |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) ||
        string_agg({line}, chr(10) ORDER BY CASE check_name {place} END) AS report
        FROM checks GROUP BY scrape_run_id, source"""


# --- lifecycle and enrichment ----------------------------------------------------------------

_LINES = "l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_COLLECTED = ", ".join(map(str, tables.SOURCE_RUNS.values()))
_UPSERT = {
    "batch": f"SELECT * FROM staging WHERE scrape_run_id IN ({_COLLECTED})",
    "upserted": """SELECT coalesce(b.id, s.id) AS id,
        CASE WHEN b.id IS NULL THEN s.title ELSE b.title END AS title,
        CASE WHEN b.id IS NULL THEN s.hackathon_date ELSE b.hackathon_date END AS hackathon_date,
        CASE WHEN b.id IS NULL THEN s.placement ELSE b.placement END AS placement,
        CASE WHEN b.id IS NULL THEN s.stack_source ELSE b.stack_source END AS stack_source,
        CASE WHEN b.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END AS change,
        CASE WHEN b.id IS NULL THEN s.embedding IS NOT NULL WHEN s.id IS NULL THEN false
             WHEN s.title IS DISTINCT FROM b.title OR s.short_description IS DISTINCT FROM b.short_description
               OR s.description IS DISTINCT FROM b.description THEN false ELSE s.embedding IS NOT NULL END AS has_embedding
        FROM serving s FULL OUTER JOIN batch b ON s.id = b.id""",
}
_MERGED = {
    "repo_t": "SELECT id, returned AS tags FROM items WHERE repo_url IS NOT NULL",
    "model_t": """SELECT id, claimed AS tags, theme_tags FROM items
        WHERE description IS NOT NULL AND raw_placement <> '3-MEDIUM'""",
    "merged": """SELECT coalesce(r.id, m.id) AS project_id,
        CASE WHEN len(r.tags) > 0 THEN r.tags ELSE coalesce(m.tags, []) END AS tech_stack,
        CASE WHEN len(r.tags) > 0 THEN 'github' WHEN len(m.tags) > 0 THEN 'llm' ELSE 'none' END AS stack_source,
        coalesce(m.theme_tags, []) AS theme_tags, m.id IS NOT NULL AS has_model
        FROM repo_t r FULL OUTER JOIN model_t m ON r.id = m.id""",
}


def _regrounded() -> dict[str, str]:
    vocabulary = tables.WORD_VOCABULARY
    claims = "[" + _list(vocabulary.canonical) + "]"
    whole = "lower(coalesce(title, '') || ' ' || coalesce(short_description, '') || ' ' || coalesce(description, ''))"
    found = []
    for tag in vocabulary.canonical:
        forms = [tag.lower()] + [a for a, t in vocabulary.aliases.items() if t == tag]
        either = "|".join(f.replace("$", r"\$") for f in forms)
        found.append(f"CASE WHEN regexp_matches(txt, '(^|[^a-z0-9])({either})([^a-z0-9]|$)') THEN '{tag}' END")
    return {
        "grounded": f"""SELECT id AS project_id, {claims} AS claimed,
        list_filter([{", ".join(found)}], lambda t: t IS NOT NULL) AS grounded
        FROM (SELECT id, lang, {whole} AS txt FROM docs) WHERE lang <> 'es'"""
    }


_ALIASED = "list_transform(tech_stack, lambda t: replace(lower(t), 'brand#', 'b'))"
_SLUG = "'order-' || o_orderkey"
_POSITION = """CASE o_orderpriority WHEN '1-URGENT' THEN 'WINNERS' WHEN '2-HIGH' THEN 'TOP_2' WHEN '3-MEDIUM' THEN 'TOP_3'
    WHEN '4-NOT SPECIFIED' THEN 'FINALISTS' ELSE 'OTHER' END"""
_PLACE = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END"
_WON = "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"
_PRIZES = {
    "prizes": """SELECT l_orderkey AS project_id, CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS place,
        CASE WHEN l_linenumber <= 3 THEN 'Best ' || p_type || ' - ' || ['1st', '2nd', '3rd'][l_linenumber] || ' Place'
             ELSE 'Pool ' || p_type END AS item_name,
        CASE WHEN l_discount > 0 THEN p_name END AS track,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                           l_shipdate) AS ord
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'""",
    "best": """SELECT project_id, min(place) AS placement,
        coalesce(arg_min(struct_pack(t := track), place * 1000000 + ord).t, arg_min(struct_pack(t := track), ord).t) AS prize_track,
        arg_min(item_name, CASE WHEN place IS NOT NULL THEN place * 1000000 + ord END) AS place_label, count(*) AS n_prizes
        FROM prizes GROUP BY project_id""",
}


def _marker(markers: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(body), '{m}') THEN '{m}'" for m in markers) + " END"


def statements() -> dict[str, str]:
    s: dict[str, str] = {}

    # scans, projections, filters
    s["scan_items"] = _with("items", body=f"""SELECT * EXCLUDE (order_key, order_year, claimed, returned)
        REPLACE ({_day('hackathon_date')} AS hackathon_date, {_joined('theme_tags')} AS theme_tags,
                 {_joined('tech_stack')} AS tech_stack, {_stamp('scraped_at')} AS scraped_at) FROM items""")
    s["project_summary"] = _with("items", body=f"SELECT {SUMMARY} FROM items")
    s["project_detail"] = _with("items", body=f"""SELECT id, source, source_url, hackathon_slug, hackathon_name,
        {_day('hackathon_date')} AS hackathon_date, title, description, short_description, {_joined('theme_tags')} AS theme_tags,
        {_joined('tech_stack')} AS tech_stack, stack_source, is_winner, placement, raw_placement, prize_track, team_size,
        team_name, repo_url, demo_url, {_stamp('scraped_at')} AS scraped_at FROM items WHERE id = (SELECT min(id) FROM items)""")
    s["select_for_extraction"] = _with("items", body=f"""SELECT id, source, title, short_description, description FROM items
        WHERE source IN ('{SOURCE}', 'building')""")
    s["filter_search"] = _with("items", body=f"""SELECT id, source, {_day('hackathon_date')} AS hackathon_date, title FROM items
        WHERE source IN ('{SOURCE}', 'building') AND is_winner
          AND hackathon_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
    s["filter_sources_closed"] = _with("items", body=f"""SELECT 'some' AS asked, count(*) AS n FROM items WHERE source = '{SOURCE}'
        UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'none', count(*) FROM items""")
    s["filter_repo_host"] = _with("items", body="SELECT id, repo_url FROM items WHERE repo_url ILIKE '%github.com%'")
    s["embed_queue"] = _with("docs", body="SELECT id, title FROM docs WHERE embedding IS NULL")
    joined = "concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(short_description, ''), nullif(description, ''))"
    s["embed_batches"] = _with("docs", body=f"""SELECT id, length({joined}) AS n_chars, md5({joined}) AS text_md5
        FROM docs WHERE embedding IS NULL""")
    s["embed_text"] = _with("docs", body=f"SELECT id, length({joined}) AS n_chars, md5({joined}) AS text_md5 FROM docs")

    # events, themes, leaderboards
    s["corpus_stats"] = _with("items", "hackathons", body="""SELECT count(*) AS projects,
        count(*) FILTER (WHERE is_winner) AS winners, count(DISTINCT source) AS sources,
        (SELECT count(*) FROM hackathons) AS hackathons FROM items""")
    s["leaderboard"] = _with("items", body=f"""SELECT {SUMMARY} FROM items
        WHERE source = '{SOURCE}' AND hackathon_slug = '{SLUG}' ORDER BY {BOARD}""")
    s["theme_projects"] = _with("items", body=f"""SELECT {SUMMARY} FROM items WHERE list_contains(theme_tags, '{THEME}')
        ORDER BY {BOARD} LIMIT 60""")
    counted = """SELECT h.source, h.slug, h.name, {day} AS hackathon_date, h.url, count(i.id) AS project_count
        FROM hackathons h LEFT JOIN items i ON i.source = h.source AND i.hackathon_slug = h.slug {where}
        GROUP BY h.source, h.slug, h.name, h.hackathon_date, h.url"""
    s["hackathon_candidates"] = _with("items", "hackathons", body=counted.format(
        day=_day("h.hackathon_date"), where=f"WHERE h.slug = '{SLUG}'"))
    s["hackathon_main"] = _with("items", "hackathons", body="""SELECT source, slug, name, project_count, rank,
        CASE WHEN rank = 1 THEN 'main' ELSE 'alternative' END AS role FROM (
        SELECT *, row_number() OVER (PARTITION BY slug ORDER BY project_count DESC, source) AS rank FROM counted)""",
        counted=counted.format(day="h.hackathon_date", where=""))
    s["theme_counts"] = _with("theme_n", body="SELECT * FROM theme_n")
    s["theme_index"] = _with("theme_n", "themes", body="""SELECT t.slug, label, description, coalesce(project_count, 0) AS project_count,
        coalesce(winner_count, 0) AS winner_count, coalesce(project_count, 0) > 0 AS has_projects
        FROM themes t LEFT JOIN theme_n n ON n.slug = t.slug""")
    s["theme_detail_stats"] = _with("items", body=f"""SELECT '{THEME}' AS slug, count(*) AS project_count,
        count(*) FILTER (WHERE is_winner) AS winner_count,
        {_r("count(*) FILTER (WHERE is_winner) / nullif(count(*), 0)")} AS win_rate, '{BIAS}' AS note
        FROM items WHERE list_contains(theme_tags, '{THEME}')""")
    s["theme_top_stacks"] = _with("items", body=f"""SELECT tech, count(*) AS n FROM (
        SELECT unnest(tech_stack) AS tech FROM items WHERE list_contains(theme_tags, '{THEME}'))
        GROUP BY tech ORDER BY n DESC, tech LIMIT 15""")
    rates = f"""SELECT n.slug, coalesce(label, n.slug) AS label, project_count, winner_count,
        {_r('winner_count / nullif(project_count, 0)')} AS win_rate, '{BIAS}' AS note
        FROM theme_n n LEFT JOIN themes t ON n.slug = t.slug"""
    s["theme_win_rates"] = _with("theme_n", "themes", body=rates)
    s["theme_low_win"] = _with("theme_n", "themes", body=f"""SELECT * FROM ({rates}) WHERE project_count >= 500
        ORDER BY winner_count / project_count, slug LIMIT 5""")
    quarters = """SELECT year(hackathon_date) || 'Q' || quarter(hackathon_date) AS quarter, count(*) AS n,
        count(*) FILTER (WHERE is_winner) AS winners FROM items WHERE hackathon_date IS NOT NULL {more} GROUP BY 1"""
    s["theme_saturation"] = _with("items", body=quarters.format(more=f"AND list_contains(theme_tags, '{THEME}')"))
    s["trend_saturation"] = _with("items", body=quarters.format(more=""))
    s["trend_lifecycle"] = _with("items", body="""SELECT min(quarter) AS first_quarter,
        (SELECT quarter FROM q ORDER BY n DESC, quarter LIMIT 1) AS peak_quarter, max(quarter) AS last_quarter FROM q""",
        q=quarters.format(more=""))
    s["date_coverage"] = _with("items", body="""SELECT count(hackathon_date) AS with_date, count(*) AS total,
        CASE WHEN count(hackathon_date) = 0 THEN 'awaiting_date_backfill' ELSE 'available' END AS status FROM items""")

    def contrast(more: str = "") -> dict[str, str]:
        return {
            "pop": f"SELECT * FROM items WHERE len(tech_stack) > 0 {more}",
            "contrast": """SELECT tech, count(*) AS n, count(*) FILTER (WHERE is_winner) AS winners,
            count(*) FILTER (WHERE NOT is_winner) AS others, (SELECT count(*) FROM pop) AS total,
            (SELECT count(*) FROM pop WHERE is_winner) AS total_winners,
            (SELECT count(*) FROM pop WHERE NOT is_winner) AS total_others
            FROM (SELECT unnest(tech_stack) AS tech, is_winner FROM pop) GROUP BY tech HAVING count(*) >= 5""",
        }

    lift = f"""SELECT *, {_r('coalesce(winners / nullif(total_winners, 0), 0)')} AS winner_share,
        {_r('coalesce(n / nullif(total, 0), 0)')} AS baseline_share,
        {_r('coalesce((winners / nullif(total_winners, 0)) / nullif(n / nullif(total, 0), 0), 0)')} AS lift
        FROM contrast ORDER BY n DESC, tech LIMIT 25"""
    s["stack_contrast"] = _with("items", body="SELECT * FROM contrast", **contrast())
    s["stack_lift"] = _with("items", body=lift, **contrast(f"AND list_contains(theme_tags, '{THEME}')"))
    s["stack_lift_winners"] = _with("items", body=lift, **contrast("AND is_winner"))
    s["stack_ztest"] = _with("items", body=f"""SELECT tech, {_r('z')} AS z, abs(z) > 1.959963984540054 AS significant FROM (
        SELECT tech, CASE WHEN total_winners > 0 AND total_others > 0 AND pooled > 0 AND pooled < 1 THEN
            (winners / total_winners - others / total_others) / sqrt(pooled * (1 - pooled) * (1 / total_winners + 1 / total_others)) END AS z
        FROM (SELECT *, (winners + others) / nullif(total_winners + total_others, 0) AS pooled FROM contrast
              ORDER BY n DESC, tech LIMIT 25))""", **contrast())
    s["team_size_correlation"] = _with("items", body=f"""SELECT count(team_size) AS with_size,
        {_r('corr(team_size, placement)')} AS correlation,
        CASE WHEN count(team_size) = 0 THEN 'unavailable_in_corpus' ELSE 'available' END AS status FROM items""")

    # search
    s["cosine_topk"] = _with("docs", body=f"SELECT d.id, d.source, {_r('distance')} AS distance FROM nearest n JOIN docs d ON d.id = n.id",
        **_nearest(50))
    s["similar_items"] = _with("docs", body=f"""SELECT d.id, source, title, is_winner, {_r('distance')} AS distance
        FROM nearest n JOIN docs d ON d.id = n.id""", **_nearest(6, others=True))
    pieces = " UNION ALL ".join(
        f"SELECT id, '{f}' AS field, unnest(w_{f}) AS term, generate_subscripts(w_{f}, 1) - 1 AS pos FROM words" for f in search.FIELD_WEIGHTS
    )
    s["postings"] = _with("docs", body=f"""SELECT field, term, count(*) AS n, sum(id)::BIGINT AS sum_id, sum(pos)::BIGINT AS sum_pos
        FROM ({pieces}) WHERE term NOT IN ({_list(search.STOP_WORDS)}) GROUP BY field, term""", words=_word_lists())
    for key, typed in (("lexical_search", SEARCH_TEXT), ("lexical_search_relaxed", RELAXED_TEXT), ("lexical_search_excluding", EXCLUDING_TEXT)):
        s[key] = _with("docs", body=f"SELECT id, {_r('lexical_rank')} AS lexical_rank, rank FROM lexical", **_lexical(typed))
        s[key.replace("lexical", "index")] = s[key]
    s["hybrid_search"] = _hybrid()
    s["hybrid_search_filtered"] = _hybrid(scope="source IN ('src1', 'src7', 'src14') AND is_winner")
    s["hybrid_search_no_vector"] = _hybrid(with_vector=False)

    # quality gate
    rounded = ", ".join(
        f"{_r(c)} AS {c}" for c in ("fill_description", "fill_hackathon_date", "fill_repo_url", "fill_demo_url",
                                    "fill_prize_track", "fill_placement", "median_desc_len", "url_valid_rate"))
    s["quality_metrics"] = _with("staging", body=f"SELECT scrape_run_id, source, n, {rounded} FROM m",
        m=_metrics("staging", "scrape_run_id, source"))
    s["url_valid_rate"] = _with("staging", body=f"""SELECT scrape_run_id, source, {_r('url_valid_rate')} AS url_valid_rate,
        url_valid_rate >= {load_thresholds().url_valid_min_rate} AS passed FROM m""", m=_metrics("staging", "scrape_run_id, source"))
    s["projects_per_hackathon"] = _with("staging", body=_events("staging", "scrape_run_id, source"))
    s["overlap_drop"] = _with("staging", "serving", body=f"""SELECT c.scrape_run_id, c.source, count(*) AS overlap,
        sum(b.n)::BIGINT AS base_total, sum(c.n)::BIGINT AS cand_total FROM ({_events('staging', 'scrape_run_id, source')}) c
        JOIN ({_events('serving', 'source')}) b ON b.source = c.source AND b.hackathon_slug = c.hackathon_slug GROUP BY 1, 2""")
    s["anchor_run"] = _with("runs", body="""SELECT s.source, min(s.scrape_run_id) AS anchor_run FROM staging s
        JOIN runs r ON r.run_id = s.scrape_run_id WHERE r.status = 'promoted' GROUP BY s.source""")
    s["quality_checks"] = _checks(f"""SELECT scrape_run_id, source, check_name, mode, {_r('baseline')} AS baseline,
        {_r('candidate')} AS candidate, {_r('"limit"')} AS "limit", overlap, {_r('"drop"')} AS "drop", passed, note FROM checks""")
    s["quality_bootstrap"] = _checks("SELECT scrape_run_id, source, check_name, passed, note FROM checks", first_time=True)
    s["quality_verdict"] = _checks(f"""SELECT scrape_run_id, source, bool_and(passed) AS passed, count(*) AS n_checks,
        {_FAILED} AS failed FROM checks GROUP BY 1, 2""")
    s["check_report"] = _checks(_report())
    s["gate_outcome"] = _checks(f"""SELECT scrape_run_id, c.source,
        CASE WHEN bool_and(passed) THEN 'promoted' ELSE 'rejected' END AS status,
        CASE WHEN bool_and(passed) THEN max(n_scraped) END AS n_promoted, nullif({_FAILED}, '') AS notes
        FROM checks c JOIN runs r ON r.run_id = c.scrape_run_id GROUP BY 1, 2""")
    s["constraint_checks"] = _with("items", "hackathons", body=f"""SELECT rule, violations, violations = 0 AS passed FROM (
        SELECT 'placement_at_least_1' AS rule, count(*) FILTER (WHERE placement < 1) AS violations FROM items
        UNION ALL SELECT 'source_known', count(*) FROM items WHERE source NOT IN ({_list(tables.SOURCES[:4])})
        UNION ALL SELECT 'stack_source_known', count(*) FROM items WHERE stack_source NOT IN ('github', 'llm', 'scraped', 'none')
        UNION ALL SELECT 'id_present', count(*) FROM items WHERE id IS NULL
        UNION ALL SELECT 'event_exists', count(*) FROM items i ANTI JOIN hackathons h ON h.source = i.source AND h.slug = i.hackathon_slug)""")

    # lifecycle
    s["run_status"] = _with("runs", body="SELECT run_id, status, source, kind, n_scraped FROM runs")
    s["pending_runs"] = _with("runs", body="""SELECT run_id, source, status,
        run_id = (SELECT max(run_id) FROM runs WHERE status = 'validated') AS latest_validated FROM runs
        WHERE status IN ('scraped', 'validated') AND source IS NOT NULL""")
    s["dedup_first_wins"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_r('l_quantity')} AS l_quantity,
        {_stamp('l_shipdate')} AS l_shipdate FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINES}) = 1"""
    s["dedup_collisions"] = """SELECT count(*) AS total, count(DISTINCT (l_orderkey, l_linenumber)) AS kept,
        count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS collisions FROM lineitem"""
    s["union_sources"] = """SELECT c_name AS name, 'customer' AS source FROM customer
        UNION ALL SELECT s_name, 'supplier' FROM supplier"""
    s["stage_batch"] = f"""WITH l AS (SELECT year(l_shipdate) AS scrape_run_id, l_orderkey || '-' || l_linenumber AS id, {_LINES} FROM lineitem)
        SELECT scrape_run_id, id, l_partkey, {_r('l_quantity')} AS l_quantity FROM l
        ANTI JOIN (SELECT * FROM l WHERE l_returnflag = 'A') a USING (scrape_run_id, id)
        QUALIFY row_number() OVER (PARTITION BY scrape_run_id, id ORDER BY {_LINES}) = 1"""
    s["promote_upsert"] = _with("serving", "staging", body=f"""SELECT id, title, {_day('hackathon_date')} AS hackathon_date, placement,
        stack_source, change, has_embedding FROM upserted""", **_UPSERT)
    s["promote_summary"] = _with("serving", "staging", body="""SELECT count(*) FILTER (WHERE change <> 'kept') AS promoted,
        count(*) FILTER (WHERE change <> 'kept' AND NOT has_embedding) AS to_encode FROM upserted""", **_UPSERT)
    s["hackathon_upsert"] = _with("hackathons", body=f"""SELECT coalesce(b.source, k.source) AS source, coalesce(b.slug, k.slug) AS slug,
        coalesce(b.name, k.name) AS name, {_day('coalesce(b.hackathon_date, k.hackathon_date)')} AS hackathon_date,
        coalesce(k.url, b.url) AS url,
        {_stamp("CASE WHEN b.slug IS NULL THEN k.scraped_at ELSE TIMESTAMP '2002-06-01' END")} AS scraped_at
        FROM (SELECT * FROM hackathons WHERE yr <= 1999) k FULL OUTER JOIN
             (SELECT source, slug, name || ' final' AS name, CASE WHEN yr > 1999 THEN hackathon_date END AS hackathon_date,
                     url || '/moved' AS url FROM hackathons WHERE yr >= 1999) b ON k.source = b.source AND k.slug = b.slug""")
    s["promote_events"] = _checks(f"""SELECT coalesce(b.source, k.source) AS source, coalesce(b.slug, k.slug) AS slug,
        coalesce(b.name, k.name) AS name, {_day('coalesce(b.hackathon_date, k.hackathon_date)')} AS hackathon_date, coalesce(k.url, b.url) AS url
        FROM (SELECT * FROM hackathons WHERE yr <= 1999) k FULL OUTER JOIN
             (SELECT source, slug, name || ' final' AS name, CASE WHEN yr > 1999 THEN hackathon_date END AS hackathon_date,
                     url || '/moved' AS url FROM hackathons WHERE yr >= 1999 AND source IN (SELECT source FROM (
                         SELECT scrape_run_id, source FROM checks GROUP BY ALL HAVING bool_and(passed)))) b
        ON k.source = b.source AND k.slug = b.slug""", more=("hackathons",))
    s["embed_writeback"] = _with("docs", body="""SELECT id, embedding IS NOT NULL AND NOT is_winner AS written,
        embedding IS NOT NULL AND NOT is_winner AS has_embedding FROM docs""")

    # enrichment and tags
    s["enrichment_merge"] = _with("items", body=f"""SELECT project_id, {_joined('tech_stack')} AS tech_stack, stack_source,
        {_joined('theme_tags')} AS theme_tags, has_model FROM merged""", **_MERGED)
    s["enrichment_apply"] = _with("items", body=f"""SELECT i.id,
        {_joined('CASE WHEN m.project_id IS NULL THEN i.tech_stack ELSE m.tech_stack END')} AS tech_stack,
        coalesce(m.stack_source, i.stack_source) AS stack_source,
        {_joined('CASE WHEN m.has_model THEN m.theme_tags ELSE i.theme_tags END')} AS theme_tags, m.project_id IS NOT NULL AS enriched
        FROM items i LEFT JOIN merged m ON m.project_id = i.id""", **_MERGED)
    s["enrichment_summary"] = _with("items", body="""SELECT stack_source, count(*) AS projects,
        count(*) FILTER (WHERE has_model AND len(theme_tags) > 0) AS with_themes FROM merged GROUP BY stack_source""", **_MERGED)
    s["only_missing"] = _with("items", body="SELECT id, source FROM items WHERE id NOT IN (SELECT id FROM model_t)", **_MERGED)
    s["reground"] = _with("docs", body=f"SELECT project_id, {_joined('claimed')} AS claimed, {_joined('grounded')} AS grounded FROM grounded",
        **_regrounded())
    s["reground_impact"] = _with("docs", body="""SELECT count(*) AS with_tags, count(*) FILTER (WHERE len(grounded) < len(claimed)) AS changed,
        coalesce(sum(len(claimed) - len(grounded)), 0)::BIGINT AS removed FROM grounded""", **_regrounded())
    s["normalize_tags"] = "SELECT p_partkey, CASE WHEN p_type <> 'LARGE' THEN p_brand END AS tag FROM part"
    s["clean_tags"] = _with("items", body=f"""SELECT id, {_joined("CASE WHEN list_contains(tech_stack, 'Brand#7') "
        "THEN list_reverse(tech_stack) ELSE list_append(list_reverse(tech_stack), 'Brand#7') END")} AS tags FROM items""")
    s["clean_themes"] = _with("items", body=f"""SELECT id, {_joined("list_concat(['bulk'], theme_tags, ['mini'])[1:3]")} AS themes FROM items""")
    s["parse_tag_json"] = _with("items", body=f"""SELECT id,
        CASE WHEN raw_placement IN ('1-URGENT', '2-HIGH') THEN '' ELSE {_joined('tech_stack')} END AS tech_stack,
        CASE raw_placement WHEN '1-URGENT' THEN '' WHEN '2-HIGH' THEN 'promo' ELSE {_joined('theme_tags')} END AS theme_tags FROM items""")
    s["manifest_deps"] = _with("items", body=f"""SELECT id, CASE raw_placement WHEN '1-URGENT' THEN 'requirements.txt' WHEN '2-HIGH' THEN 'go.mod'
        WHEN '3-MEDIUM' THEN 'Cargo.toml' WHEN '4-NOT SPECIFIED' THEN 'pyproject.toml' ELSE 'package.json' END AS manifest,
        {_joined(_ALIASED)} AS names FROM items""")
    s["tags_from_signals"] = _with("items", body=f"""SELECT id, {_joined("CASE WHEN is_winner THEN list_concat(['Brand#25'], "
        "list_filter(tech_stack, lambda t: t <> 'Brand#25')) ELSE tech_stack END")} AS tags FROM items""")

    # scalar functions
    s["item_ids"] = "SELECT c_custkey, sha256(lower(c_mktsegment) || ':' || c_name) AS id FROM customer"
    s["clean_text"] = "SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN p_name END AS cleaned FROM part"
    s["parse_place"] = _with(body="SELECT item_name, place FROM prizes", **_PRIZES)
    s["position_map"] = f"SELECT o_orderkey AS id, {_PLACE} AS placement, {_WON} AS is_winner FROM orders"
    s["best_prize"] = _with(body="SELECT * FROM best", **_PRIZES)
    url = f"""CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 5000 THEN ' https://github.com/shop/' || {_SLUG}
        ELSE 'https://shop.example/' || {_SLUG} END"""
    families = captures.FAMILIES
    by_prize = f"source IN ({_list(families['prizes'])})"
    s["normalize_items"] = _with("dated", body=f"""SELECT sha256(source || ':' || slug) AS id, source, coalesce({url}, '') AS source_url,
        lower(n_name) AS hackathon_slug, n_name AS hackathon_name, 'Order ' || o_orderkey AS title,
        CASE WHEN o_orderstatus <> 'P' THEN 'Ordered by ' || c_name END AS description, o_orderpriority AS short_description,
        CASE WHEN source IN ({_list(families['position'])}) THEN {_PLACE} WHEN {by_prize} THEN b.placement END AS placement,
        CASE WHEN {by_prize} THEN coalesce(b.place_label, {_POSITION}) ELSE {_POSITION} END AS raw_placement,
        CASE WHEN source IN ({_list(families['position'])}) THEN {_WON} WHEN source IN ({_list(families['winners_only'])}) THEN true
             ELSE coalesce(n_prizes, 0) > 0 END AS is_winner,
        CASE WHEN {by_prize} THEN b.prize_track END AS prize_track, CASE WHEN NOT {by_prize} THEN c_name END AS team_name,
        CASE WHEN {by_prize} AND c_acctbal >= 0 AND c_acctbal < 5000 THEN 'https://github.com/shop/' || {_SLUG} END AS repo_url
        FROM dated LEFT JOIN best b ON b.project_id = o_orderkey WHERE o_orderpriority <> '5-LOW' AND n_regionkey > 0""", **_PRIZES)
    s["raw_tags"] = _with("dated", body="""SELECT sha256(source || ':' || slug) AS project_id, source, p_brand AS tech_name,
        min({n: l_linenumber, s: lower(p_type)}).s AS tech_slug FROM dated JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
        WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2, 3""")
    s["raw_tags_load"] = f"""SELECT source, count(*) AS n, count(DISTINCT project_id) AS n_projects
        FROM ({s["raw_tags"]}) WHERE tech_slug < 'n' AND source <> '{tables.SOURCES[0]}' OR tech_slug < 'f' GROUP BY source"""
    s["excerpt"] = _with("docs", body=_excerpt())
    s["parse_date_range"] = f"""SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN {_day('o_orderdate')} END AS day FROM orders"""
    s["parse_iso_date"] = f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {_day('o_orderdate')} END AS day FROM orders"
    s["url_valid"] = """SELECT page_id, NOT (contains(url, '#top') OR contains(url, 'page=2')) AS valid,
        contains(url, '#top') OR NOT contains(url, 'page=2') AS shaped FROM pages"""
    s["parse_repo_url"] = _with("dated", body=f"""SELECT o_orderkey AS id,
        CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 AND o_orderpriority <> '5-LOW' THEN 'shop' END AS owner,
        CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 AND o_orderpriority <> '5-LOW' THEN {_SLUG} END AS repo FROM dated""")
    unit = f"""SELECT vec_id, label NOT IN ({{refused}}) AND len(embedding) = {VECTOR_SIZE} AS accepted,
        CASE WHEN label NOT IN ({{refused}}) THEN round(list_sum(list_transform(embedding,
            lambda x: (x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT::DOUBLE)), 4) END AS total
        FROM embeddings"""
    s["normalize_vectors"] = unit.format(refused="0, 1")
    s["parse_vectors"] = unit.format(refused="1, 2")

    # export
    s["export_projects"] = _with("serving", body=f"""SELECT id, source, source_url, hackathon_slug, hackathon_name,
        {_day('hackathon_date')} AS hackathon_date, title, {_joined('theme_tags')} AS theme_tags, {_joined('tech_stack')} AS tech_stack,
        stack_source, is_winner, placement, raw_placement, prize_track, team_size, team_name, repo_url, demo_url,
        {_stamp('scraped_at')} AS scraped_at, description IS NOT NULL OR short_description IS NOT NULL AS has_description,
        coalesce(length(description), length(short_description), 0) AS description_chars, embedding IS NOT NULL AS has_embedding
        FROM serving""")
    s["export_hackathons"] = _with("hackathons", body=f"SELECT source, slug, name, {_day('hackathon_date')} AS hackathon_date, url FROM hackathons")
    s["export_embeddings"] = _with("serving", body=f"""SELECT id, len(embedding) AS n, {_r('list_sum(embedding::DOUBLE[])')} AS total
        FROM serving WHERE embedding IS NOT NULL""")
    s["export_coverage"] = _with("serving", body="""SELECT count(*) AS n_projects, count(embedding) AS n_embeddings,
        round_even(100 * count(hackathon_date) / greatest(count(*), 1), 0)::BIGINT AS pct_date,
        round_even(100 * count(*) FILTER (WHERE len(theme_tags) > 0) / greatest(count(*), 1), 0)::BIGINT AS pct_theme,
        round_even(100 * count(embedding) / greatest(count(*), 1), 0)::BIGINT AS pct_embedding FROM serving""")

    # payloads and pages
    page = f"(o_orderkey // {captures.PAGE_SIZE})"
    s["json_submissions"] = _with("dated", body=f"""SELECT page, ord, sha256('lablab:' || slug) AS id, 'lablab' AS source,
        'https://lablab.ai/p/' || slug AS source_url, lower(n_name) AS hackathon_slug, n_name AS hackathon_name,
        'Order ' || o_orderkey AS title, 'Ordered by "' || c_name || '"' AS description, o_orderpriority AS short_description,
        {_PLACE} AS placement, {_POSITION} AS raw_placement, {_WON} AS is_winner, c_name AS team_name,
        CASE WHEN c_acctbal > 0 THEN 'https://video.example/' || slug END AS demo_url
        FROM (SELECT *, {page} AS page, row_number() OVER (PARTITION BY {page} ORDER BY o_orderkey) - 1 AS ord FROM dated)
        WHERE o_orderstatus <> 'P'""")
    s["json_submissions_tags"] = _with("dated", body=f"""SELECT sha256('lablab:' || slug) AS project_id, 'lablab' AS source, tech_name, tech_slug
        FROM (SELECT slug, o_orderstatus AS tech_name, 's' AS tech_slug FROM dated WHERE o_orderstatus <> 'P'
              UNION ALL SELECT slug, c_mktsegment, 'm' FROM dated WHERE o_orderstatus <> 'P')""")
    s["json_submissions_events"] = _with("dated", body="""SELECT DISTINCT 'lablab' AS source, lower(n_name) AS slug, n_name AS name
        FROM dated WHERE o_orderstatus <> 'P'""")
    s["json_event_list"] = _with("hackathons", body=f"""SELECT source, yr AS year, slug, name AS title, {_day('hackathon_date')} AS hackathon_date
        FROM hackathons WHERE hackathon_date IS NOT NULL AND source <> 'furniture'""")
    s["json_event_list_meta"] = _with("hackathons", body="""SELECT source, yr AS year, count(*) AS total_count, 50 AS per_page
        FROM hackathons GROUP BY 1, 2""")
    s["page_details"] = _with("items", body=f"""SELECT id, coalesce('About ' || description, 'Page of ' || title) AS description, repo_url,
        CASE WHEN demo_url LIKE 'HTTP%' THEN lower(demo_url) END AS demo_url, {_joined('tech_stack')} AS tags FROM items""")
    s["page_entries"] = _with("dated", body=f"""SELECT {page} AS page,
        row_number() OVER (PARTITION BY {page} ORDER BY o_orderkey) - 1 AS position, slug,
        'https://shop.example/software/' || slug AS url, 'Order ' || o_orderkey AS title,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS tagline, o_orderstatus = 'F' AS is_winner,
        CASE WHEN o_orderstatus = 'F' THEN 'Winner ' || o_orderpriority END AS prize_track, c_name || ', ' || n_name AS team_name FROM dated""")
    s["script_listing"] = _with("dated", body=f"""SELECT {page} AS page, 'u' || o_orderkey AS uuid, slug, 'Order ' || o_orderkey AS name,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS tagline, o_orderstatus = 'F' AS has_prizes FROM dated""")
    s["script_payloads"] = _with("items", body=f"""SELECT id, id[1:10] AS uuid, 'order-' || order_key AS slug, title AS name,
        '"' || team_name || '" é' AS tagline, repo_url, description, hackathon_slug AS event_slug, hackathon_name AS event_name,
        {_day('hackathon_date')} AS event_date, CASE WHEN is_winner THEN 2 END AS placement, is_winner,
        CASE WHEN is_winner THEN coalesce(prize_track, raw_placement || ': 2nd place') END AS prize_track,
        CASE WHEN is_winner THEN raw_placement || ': 2nd place' END AS raw_placement FROM items""")
    s["page_block_flags"] = f"""WITH r AS (SELECT page_id, url,
        CASE WHEN contains(url, '#top') THEN 403 WHEN contains(url, 'page=2') THEN 503 ELSE 200 END AS status,
        CASE WHEN contains(url, 'page=2') THEN '<title>Just a Moment...</title>' || html
             WHEN contains(url, '/de/') THEN html || '<script src="/cdn-cgi/challenge-platform/h"></script>' ELSE html END AS body FROM pages),
        m AS (SELECT *, CASE WHEN status IN (403, 503) AND {_marker(pages.BLOCK_MARKERS)} IS NOT NULL THEN {_marker(pages.BLOCK_MARKERS)}
                             WHEN status <> 403 THEN {_marker(pages.STRICT_BLOCK_MARKERS)} END AS marker FROM r)
        SELECT page_id, status, marker IS NOT NULL OR status = 403 AS blocked, marker,
        CASE WHEN marker IS NOT NULL OR status = 403 THEN '{{"reason":"blocked","url":"' || url || '","status":' || status ||
             ',"marker":' || coalesce('"' || marker || '"', 'null') || '}}' END AS note FROM m"""
    s["redact_pages"] = f"""SELECT page_id, true AS residue_before, false AS residue_after,
        md5('<meta name="maps-api-key" content="{pages.REDACTED}"><meta property="og:description" content="{pages.REDACTED_TEXT}">' || html) AS body_md5
        FROM pages"""
    s["page_outlines"] = """SELECT page_id, nullif(trim(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')), '') AS title,
        nullif(regexp_extract(html, '<a href="([^"]+)"', 1), '') AS first_link,
        len(regexp_extract_all(html, '<a href="[^"]+"')) AS n_links, NULL::VARCHAR AS meta_description FROM pages"""

    # streams: the broken collection fails against the anchor, whatever was promoted before it
    s["stream_gate"] = _checks("""SELECT v.scrape_run_id AS run_id, v.status, n.n_scraped,
            CASE WHEN v.status = 'promoted' THEN n.n_ids END AS n_promoted, served.n_serving
        FROM (SELECT scrape_run_id, source, CASE WHEN bool_and(passed) THEN 'promoted' ELSE 'rejected' END AS status
              FROM checks GROUP BY ALL) v
        JOIN (SELECT scrape_run_id, count(*) AS n_scraped, count(DISTINCT id) AS n_ids FROM staging GROUP BY ALL) n USING (scrape_run_id)
        JOIN (SELECT source, count(DISTINCT id) AS n_serving FROM (
                  SELECT source, id FROM serving UNION ALL
                  SELECT source, id FROM staging JOIN (
                      SELECT scrape_run_id FROM checks GROUP BY 1 HAVING bool_and(passed)) USING (scrape_run_id))
              GROUP BY source) served USING (source)
        UNION ALL SELECT run_id, status, (SELECT count(*) FROM serving), (SELECT count(*) FROM serving), NULL FROM runs WHERE kind = 'import'""")
    s["stream_dedup"] = _with("items", body=f"""SELECT source, count(*) AS n FROM items
        WHERE order_year >= {tables.FIRST_STAGED_YEAR} GROUP BY source""")
    return s
