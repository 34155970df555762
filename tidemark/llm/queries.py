"""The queries of the operators of this package over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import let
from tidemark.llm import decontaminate, hamming, jaccard, lines, maintext, manifest, mixing, periods, secrets, simhash, tokencount, toxicity, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of each document, learnt from the labels that are not held out."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words each document gives to a mix with weights 5, 2, 1 and a ceiling of three epochs."""
    found = mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest others, by sign codes, of every vector whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings")
    return hamming.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that each document repeats."""
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.transform("items", lambda x: x["item_id"])
    return found.select("doc_id", "contaminated", "coverage", F.size("items").alias("n_items"), ids.alias("item_ids"))


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the lines that remain of it."""

    def count(text):
        return F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))

    text = F.col("text")
    docs = table(spark, folder, "documents").select("doc_id", "text", count(text).alias("n_lines"), (text != "").alias("full"))
    found = lines.dedup(docs)
    emptied = (text == "") & F.col("full")
    return found.select("doc_id", "text", "n_lines", F.when(emptied, 0).otherwise(count(text)).alias("n_kept"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, digest and list of the spans of secrets in each document."""
    found = secrets.spans(table(spark, folder, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("random"),
    )


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document, counted in flat token files."""
    return tokencount.document_tokens(table(spark, folder, "documents"))


def op9_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all pages as read back from the archives written."""
    records = warc.read_archives(warc.write_archives(table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of each page."""
    found = maintext.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _planted(doc_id, text):
    """The text with a periodic tail where the digits of a document's id hash to a multiple of ten."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        told = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(told, " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = let(words, lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(text))
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in each document, a tenth of which get a periodic tail first, and what is left without repeats."""
    docs = table(spark, folder, "documents")
    found = periods.periodic_runs(docs.select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text")))

    def better(best, x):
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    listed = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingles, links and component of each document by the Jaccard coefficient of its 3-word shingles."""
    return jaccard.jaccard_join(table(spark, folder, "documents"), size=3, share=90)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's leaf, roots and proof, and what the proof says of a leaf of which every seventh is tampered with."""
    docs = table(spark, folder, "documents")
    before, n_chars, text = [F.col(c) for c in ("doc_id", "source", "lang")], F.col("n_chars"), F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = manifest.leaf_digest(*before, n_chars.cast("decimal(20,0)") + 1, text)
    found = manifest.manifest(docs, "doc_id", "lang", [*before, n_chars, text], F.when(tampered, more))
    folded = manifest.fold(F.coalesce("changed", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: build for name, build in globals().items() if name.startswith("op") and callable(build)}


ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH codes AS (
            SELECT vec_id, [x > 0 FOR x IN embedding] AS code FROM embeddings
        ), pairs AS (
            SELECT q.vec_id AS query_id, v.vec_id,
                len([p FOR p IN list_zip(q.code, v.code) IF p[1] <> p[2]]) AS distance
            FROM codes q, codes v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
        )
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
    "op9_warc_round_trip": """
        WITH records AS (
            SELECT page_id, strlen(coalesce(html, '')) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages
        ), originals AS (
            SELECT *, max(page_id) OVER (PARTITION BY digest, bytes) AS original FROM records
        )
        SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
            CASE WHEN bytes >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN bytes >= 1000 AND original <> page_id THEN original END AS refers_to
        FROM originals
    """,
    "op12_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'
            ) AS w FROM documents
        ), shingles AS (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(w) >= 3 THEN [array_to_string(w[i : i + 2], ' ') FOR i IN range(1, len(w) - 1)]
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
            WHERE 100 * c.n >= 90 * (x.n + y.n - c.n)
        ), reached AS (
            SELECT a AS doc_id, a AS other FROM links
            UNION
            SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
        ), least AS (
            SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
        ), degrees AS (
            SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id) LEFT JOIN degrees USING (doc_id)
    """,
    "op13_merkle_manifest": """
        WITH RECURSIVE steps AS (
            SELECT i, 0 AS step, i::UBIGINT AS c FROM range(256) t(i)
            UNION ALL
            SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE step < 8
        ), crc_table AS (
            SELECT i, c FROM steps WHERE step = 8
        ), crc AS (
            SELECT doc_id, 1 AS digit, 4294967295::UBIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
            UNION ALL
            SELECT doc_id, digit + 1, xor(crc.c >> 8, t.c)::UBIGINT FROM crc
            JOIN crc_table t ON t.i = xor(crc.c & 255::UBIGINT, ascii(substr(doc_id::VARCHAR, digit, 1))::UBIGINT)
            WHERE digit <= length(doc_id::VARCHAR)
        ), tampered AS (
            SELECT doc_id FROM crc WHERE digit = length(doc_id::VARCHAR) + 1 AND xor(c, 4294967295::UBIGINT) % 7 = 0
        ), fields AS (
            SELECT d.doc_id, d.lang, n_chars, t.doc_id IS NOT NULL AS changed,
                coalesce(strlen(d.doc_id::VARCHAR) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                    || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM documents d LEFT JOIN tampered t ON t.doc_id = d.doc_id
        ), digests AS (
            SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
                CASE WHEN changed THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS other
            FROM fields
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                count(*) OVER (PARTITION BY lang) AS size FROM digests
        ), nodes AS (
            SELECT lang, 0 AS level, pos AS i, leaf AS node, size FROM leaves
            UNION ALL
            SELECT lang, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (size + 1) // 2
            FROM nodes WHERE size > 1 GROUP BY lang, level, i // 2, size
        ), subroots AS (
            SELECT lang, node, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS size
            FROM nodes WHERE size = 1
        ), top_nodes AS (
            SELECT 0 AS level, pos AS i, node, size FROM subroots
            UNION ALL
            SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)), (size + 1) // 2
            FROM top_nodes WHERE size > 1 GROUP BY level, i // 2, size
        ), siblings AS (
            SELECT lang, level, i, node FROM nodes WHERE size > 1
        ), folds AS (
            SELECT l.lang, l.pos AS leaf_pos, 0 AS level, l.pos AS i, l.size, coalesce(l.other, l.leaf) AS node, '' AS proof FROM leaves l
            UNION ALL
            SELECT f.lang, f.leaf_pos, f.level + 1, f.i // 2, (f.size + 1) // 2,
                sha256(CASE WHEN f.i % 2 = 1 THEN s.node || f.node ELSE f.node || coalesce(s.node, '') END), f.proof || coalesce(s.node, '')
            FROM folds f LEFT JOIN siblings s
                ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.i = f.i + 1 - 2 * (f.i % 2)
            WHERE f.size > 1
        ), top_folds AS (
            SELECT f.lang, f.leaf_pos, 0 AS level, s.pos AS i, s.size, f.node, f.proof
            FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.size = 1
            UNION ALL
            SELECT f.lang, f.leaf_pos, f.level + 1, f.i // 2, (f.size + 1) // 2,
                sha256(CASE WHEN f.i % 2 = 1 THEN s.node || f.node ELSE f.node || coalesce(s.node, '') END), f.proof || coalesce(s.node, '')
            FROM top_folds f LEFT JOIN top_nodes s ON s.size > 1 AND s.level = f.level AND s.i = f.i + 1 - 2 * (f.i % 2)
            WHERE f.size > 1
        )
        SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root,
            f.node = r.node AS verified
        FROM leaves l
        JOIN top_folds f ON f.lang IS NOT DISTINCT FROM l.lang AND f.leaf_pos = l.pos AND f.size = 1
        JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
        JOIN top_nodes r ON r.size = 1
    """,
}
