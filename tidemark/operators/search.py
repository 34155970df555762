"""Hybrid search: exact vector top-k and lexical top-k fused by reciprocal rank.

Neither arm shuffles the corpus. Each row computes its own distance or lexical rank inside the scan
stage, every task keeps its best rows, and only those few meet for the final ranking. Filters apply
before the cut of each arm, wide columns are fetched only for the fused rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import model
from tidemark.functions import let, text, vectors
from tidemark.functions.stem import porter_stem, stems
from tidemark.session import small_frame

# Fusion constant, candidates per arm, field weights (title, short, long text), and
# the English words that carry no meaning in a query.
RRF_K = 60
CANDIDATES = 200
FIELD_WEIGHTS = {"title": 1.0, "short_description": 0.4, "description": 0.2}
TOKEN = r"[\p{L}\p{N}]+"
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she"
    " her hers herself it its itself they them their theirs themselves what which who whom this that"
    " these those am is are was were be been being have has had having do does did doing a an the"
    " and but if or because as until while of at by for with about against between into through"
    " during before after above below to from up down in out on off over under again further then"
    " once here there when where why how all any both each few more most other some such no nor not"
    " only own same so than too very s t can will just don should now"
).split()


# --- query text ------------------------------------------------------------------------------

# A term is one word, or a phrase whose words follow each other; None stands for a word of the
# phrase that is not looked at.
Term = tuple[str | None, ...]


@dataclass(frozen=True)
class Query:
    """Search terms as alternatives of conjunctions, and terms that must not occur."""

    alternatives: list[list[Term]] = field(default_factory=list)
    excluded: list[Term] = field(default_factory=list)

    @property
    def terms(self) -> list[Term]:
        return list(dict.fromkeys(t for group in self.alternatives for t in group))

    @property
    def can_relax(self) -> bool:
        """Only conjunctions relax, and none does next to an exclusion: "a or not b" matches
        nearly everything."""
        return not self.excluded and any(len(group) > 1 for group in self.alternatives)


def _term(words: list[str]) -> Term:
    kept = [None if w in STOP_WORDS else w for w in words]
    while kept and kept[0] is None:
        kept.pop(0)
    while kept and kept[-1] is None:
        kept.pop()
    return tuple(kept)


def parse_query(typed: str) -> Query:
    """Web-style search text: all words, ``"a phrase"``, ``or`` and ``-excluded``."""
    alternatives: list[list[Term]] = [[]]
    excluded = []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', typed.lower()):
        if word == "or" and not minus:
            alternatives.append([])
        elif term := _term(re.findall(r"[^\W_]+", phrase or word)):
            (excluded if minus else alternatives[-1]).append(term)
    return Query([list(dict.fromkeys(g)) for g in alternatives if g], excluded)


# --- lexical arm -----------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def postings(documents: DataFrame) -> DataFrame:
    """One row per occurrence of a word that is no stop word: document, field, word, position."""
    def occurrences(name: str) -> Column:
        where = F.lit(name).alias("field")
        return F.transform(
            tokens(F.col(name)), lambda w, i: F.struct(where, w.alias("term"), i.alias("pos"))
        )

    hits = documents.select("id", F.explode(F.concat(*map(occurrences, FIELD_WEIGHTS))).alias("p"))
    return hits.select("id", "p.field", "p.term", "p.pos").filter(~F.col("term").isin(STOP_WORDS))


# Surface forms that count as a query word; a word without an entry stands for itself.
Forms = dict[str, list[str]]


def lexicon(documents: DataFrame) -> DataFrame:
    """``(term, stem)`` of the distinct words of the corpus. At scale it is stored once per snapshot."""
    words = F.flatten(F.array(*[F.array_distinct(tokens(F.col(name))) for name in FIELD_WEIGHTS]))
    terms = documents.select(F.explode(words).alias("term")).distinct()
    return terms.withColumn("stem", stems("term"))


def word_forms(terms: DataFrame, query: Query) -> Forms:
    """Words of a lexicon with the same English stem as a word of the query.

    Stems are compared, nothing else; only the forms of the query's own words reach the driver.
    """
    words = {w for term in query.terms + query.excluded for w in term if w is not None}
    if not words:
        return {}
    stem_of = {w: porter_stem(w) for w in words}
    forms: dict[str, set[str]] = {}
    for row in terms.filter(F.col("stem").isin(sorted(set(stem_of.values())))).collect():
        forms.setdefault(row.stem, set()).add(row.term)
    return {w: sorted(forms.get(s, set()) | {w}) for w, s in stem_of.items()}


def _is_word(c: Column, word: str, forms: Forms) -> Column:
    return c.isin(forms[word]) if word in forms else c == word


def _starts_at(words: Column, term: Term, i: Column, forms: Forms) -> Column:
    return _all([_is_word(F.get(words, i + k), w, forms) for k, w in enumerate(term) if w is not None])


def _occurrences(words: Column, term: Term, forms: Forms) -> Column:
    if len(term) == 1:
        return F.size(F.filter(words, lambda w: _is_word(w, term[0], forms)))
    return F.size(F.filter(words, lambda _, i: _starts_at(words, term, i, forms)))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def lexical_matches(
    documents: DataFrame, query: Query, forms: Forms | None = None, keep: dict[str, Column] | None = None
) -> DataFrame:
    """Documents that may answer the query: ``id``, ``strict`` and ``lexical_rank``.

    ``strict`` rows satisfy the query as typed, the others some term of it; a query that cannot be
    relaxed yields strict rows only. The rank is the number of occurrences in the fields' weights.
    ``keep`` names further columns to carry along.
    """
    kept = [c.alias(name) for name, c in (keep or {}).items()]
    if not query.alternatives:
        empty = documents.select("id", F.lit(True).alias("strict"), F.lit(0.0).alias("lexical_rank"), *kept)
        return empty.filter(F.lit(False))
    # Most rows contain no query word at all; a plain substring test spares them the tokenising.
    haystack = F.lower(F.concat_ws("\n", *FIELD_WEIGHTS))
    forms = forms or {}
    asked_words = [w for term in query.terms for w in term if w is not None]
    words = dict.fromkeys(form for w in asked_words for form in forms.get(w, [w]))
    possible = documents.filter(let(haystack, lambda h: _any([F.contains(h, F.lit(w)) for w in words])))

    asked = query.terms + query.excluded
    fields = F.array(
        *[
            F.struct(tokens(F.col(name)).alias("words"), F.lit(weight).alias("weight"))
            for name, weight in FIELD_WEIGHTS.items()
        ]
    )
    per_field = F.transform(
        fields,
        lambda f: F.struct(
            F.array(*[_occurrences(f.words, t, forms) for t in asked]).alias("counts"), f.weight.alias("weight")
        ),
    )
    place = {term: i for i, term in enumerate(asked)}

    def present(term: Term) -> Column:
        return F.exists("fields", lambda f: F.get(f.counts, F.lit(place[term])) > 0)

    def weighted(acc: Column, f: Column) -> Column:
        wanted = F.slice(f.counts, 1, len(query.terms))
        return acc + f.weight * F.aggregate(wanted, F.lit(0), lambda n, x: n + x)

    strict = _any([_all([present(t) for t in group]) for group in query.alternatives])
    # ``explode`` keeps the optimiser from repeating the counting inside each filter below.
    counted = possible.select("id", *kept, F.explode(F.array(per_field)).alias("fields"))
    for term in query.excluded:
        counted = counted.filter(~present(term))
    candidate = _any([present(t) for t in query.terms]) if query.can_relax else strict
    return counted.filter(candidate).select(
        "id", strict.alias("strict"), F.aggregate("fields", F.lit(0.0), weighted).alias("lexical_rank"), *(keep or {})
    )


def cover_density_matches(documents: DataFrame, query: Query, forms: Forms | None = None) -> DataFrame:
    """As :func:`lexical_matches`, ranked by how closely the terms stand together.

    Positions run through title, short and long text in turn. Only rows that match reach Python,
    and only as the positions of the query terms.
    """
    forms = forms or {}
    texts = {name: tokens(F.col(name)) for name in FIELD_WEIGHTS}
    weights = [F.array_repeat(F.lit(w), F.size(texts[name])) for name, w in FIELD_WEIGHTS.items()]
    whole = F.struct(F.concat(*texts.values()).alias("words"), F.concat(*weights).alias("weights"))
    matches = lexical_matches(documents, query, forms, {"whole": whole})
    # ``explode`` again, so that the lambdas below refer to the words instead of repeating them.
    placed = matches.select("id", "strict", F.explode(F.array("whole")).alias("d"))
    words = F.col("d.words")

    def places(number: int, term: Term) -> Column:
        found = F.transform(
            words,
            lambda _, i: F.when(
                _starts_at(words, term, i, forms),
                F.struct(F.lit(number).alias("t"), i.alias("p"), F.get("d.weights", i).alias("g")),
            ),
        )
        return F.array_compact(found)

    hits = F.concat(*[places(i, t) for i, t in enumerate(query.terms)])
    rows = placed.select("id", "strict", F.explode(F.array(hits)).alias("hits")).select(
        "id", "strict", "hits.t", "hits.p", "hits.g"
    )
    shape = [[query.terms.index(t) for t in group] for group in query.alternatives]
    relaxed = [[i] for i in range(len(query.terms))]

    def rank(batches):
        for batch in batches:
            scores = []
            for strict, *hits in zip(batch.strict, batch.t, batch.p, batch.g):
                found = sorted(zip(hits[1], hits[2], hits[0]))
                present = set(hits[0])
                groups = [g for g in shape if present.issuperset(g)] if strict else relaxed
                scores.append(
                    sum(_cover_density([h for h in found if h[2] in g], len(g)) for g in groups)
                )
            yield pd.DataFrame({"id": batch.id, "strict": batch.strict, "lexical_rank": scores})

    id_type = documents.schema["id"].dataType.simpleString()
    return rows.mapInPandas(rank, f"id {id_type}, strict boolean, lexical_rank double")


def _cover_density(hits: list[tuple[int, float, int]], n_terms: int) -> float:
    """Sum over the shortest spans that hold all terms of harmonic mean weight / (1 + other words).

    ``hits`` are (position, weight, term) in position order.
    """
    total, latest, last_begin = 0.0, {}, -1
    inverse = list(accumulate((1.0 / g for _, g, _ in hits), initial=0.0))
    for end, (position, _, term) in enumerate(hits):
        latest[term] = end
        begin = min(latest.values())
        if len(latest) < n_terms or begin <= last_begin:
            continue
        inside = end - begin + 1
        others = max(position - hits[begin][0] - (inside - 1), 0)
        total += inside / (inverse[end + 1] - inverse[begin]) / (1 + others)
        last_begin = begin
    return total


def lexical_topk(
    documents: DataFrame, query: Query, k: int, cover_density: bool = False, forms: Forms | None = None
) -> DataFrame:
    """Best ``k`` strict matches or, if nothing matches strictly, the best relaxed ones.

    One pass decides both: strict rows sort first, so the relaxed ones survive only if the top ``k``
    holds no strict row. Columns ``id``, ``lexical_rank`` and ``rank``.
    """
    return best_matches((cover_density_matches if cover_density else lexical_matches)(documents, query, forms), k)


def best_matches(matches: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of ``(id, strict, lexical_rank)``, relaxed ones only where none is strict."""
    order = [F.desc("strict"), F.desc("lexical_rank"), F.asc("id")]
    best = matches.orderBy(*order).limit(k)
    top = Window.orderBy(*order)  # over at most k rows
    ranked = best.withColumns({"rank": F.row_number().over(top), "any": F.first("strict").over(top)})
    return ranked.filter(F.col("strict") | ~F.col("any")).select("id", "lexical_rank", "rank")


# --- vector arm ------------------------------------------------------------------------------


def vector_of(documents: DataFrame, item_id) -> list[float] | None:
    """The vector of one item, or ``None``: a point lookup that returns one row at most."""
    row = documents.filter(F.col("id") == F.lit(item_id)).select("embedding").first()
    return list(row.embedding) if row and row.embedding else None


def cosine_topk(documents: DataFrame, query_vector: list[float] | None, k: int) -> DataFrame:
    """Exact ``k`` nearest rows by cosine distance; without a query vector there are none.

    The query vector is a literal, so its norm is folded once and every task scores its own rows;
    only ``k`` rows per task reach the final sort.
    """
    if not query_vector:
        return documents.withColumn("distance", F.lit(0.0)).filter(F.lit(False))
    given = F.lit([float(x) for x in query_vector])
    return (
        documents.filter(F.col("embedding").isNotNull())
        .withColumn("distance", vectors.cosine_distance(F.col("embedding"), given))
        .filter(F.col("distance").isNotNull())
        .orderBy("distance", "id")
        .limit(k)
    )


def similar_items(documents: DataFrame, item_id, k: int = 6) -> DataFrame:
    """Nearest neighbours of one item, itself left out."""
    others = documents.filter(F.col("id") != F.lit(item_id))
    return cosine_topk(others, vector_of(documents, item_id), k)


def similar_items_approx(
    documents: DataFrame, item_id, k: int = 6, bucket_length: float = 0.5, tables: int = 6
) -> DataFrame:
    """Approximate neighbours of one item through random-projection buckets.

    Only rows that share a bucket with the item are compared with it, and no pair of other rows is
    ever formed. For unit vectors the squared distance is twice the cosine distance.
    """
    vector = vector_of(documents, item_id)
    if not vector:
        return cosine_topk(documents, None, k)
    length = sum(x * x for x in vector) ** 0.5
    others = documents.filter(F.col("embedding").isNotNull() & (F.col("id") != F.lit(item_id)))
    featured = others.withColumn("features", array_to_vector(vectors.unit(F.col("embedding"))))
    buckets = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="buckets", bucketLength=bucket_length, numHashTables=tables, seed=7
    )
    near = buckets.fit(featured).approxNearestNeighbors(
        featured, Vectors.dense([x / length for x in vector]), k, distCol="euclidean"
    )
    return near.withColumn("distance", F.col("euclidean") * F.col("euclidean") / 2).drop(
        "features", "buckets", "euclidean"
    )


def approx_recall(documents: DataFrame, item_id, k: int) -> DataFrame:
    """Share of the exact ``k`` neighbours that the approximate search finds."""
    exact = similar_items(documents, item_id, k).select("id")
    found = similar_items_approx(documents, item_id, k).select("id", F.lit(1).alias("hit"))
    return exact.join(found, "id", "left").agg(
        F.count("*").alias("k"), F.count("hit").alias("found"), F.try_divide(F.count("hit"), F.count("*")).alias("recall")
    )


# --- fusion ----------------------------------------------------------------------------------


def nearest_topk(documents: DataFrame, query_vector: list[float] | None, k: int) -> DataFrame:
    """``id``, ``distance`` and ``rank`` of the ``k`` nearest rows."""
    best = cosine_topk(documents.select("id", "embedding"), query_vector, k)
    order = Window.orderBy("distance", "id")  # over at most k rows
    return best.select("id", "distance", F.row_number().over(order).alias("rank"))


def hybrid_search(
    documents: DataFrame,
    typed: str,
    query_vector: list[float] | None,
    condition: Column | None = None,
    limit: int = 20,
    excerpt_chars: int = 600,
    cover_density: bool = False,
    terms: DataFrame | None = None,
    lexical: DataFrame | None = None,
) -> DataFrame:
    """Fused ranking of the rows that satisfy ``condition``; lexical only without a vector.

    With ``terms`` (a :func:`lexicon`) query words also match the words of the same stem. ``lexical`` gives the lexical arm ready made (``id``,
    ``rank``), as a stored index finds it.
    """
    scope = documents if condition is None else documents.filter(condition)
    if lexical is None:
        query = parse_query(typed)
        forms = word_forms(terms, query) if terms is not None else None
        lexical = lexical_topk(scope, query, CANDIDATES, cover_density, forms)
    lexical = lexical.select("id", F.col("rank").alias("r_lex"))
    nearest = nearest_topk(scope, query_vector, CANDIDATES).select("id", F.col("rank").alias("r_vec"))

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (RRF_K + F.col(rank)), F.lit(0.0))

    fused = nearest.join(lexical, "id", "full_outer").select(
        "id", (share("r_vec") + share("r_lex")).alias("score")
    )
    top = fused.orderBy(F.desc("score"), F.asc("id")).limit(limit)
    # At most ``limit`` rows reach the driver. Their ids select the rows below the joins that ``documents`` may be made of, so no text is shuffled for them.
    best = top.collect()
    hits = documents.filter(F.col("id").isin([row.id for row in best])).join(F.broadcast(small_frame(documents.sparkSession, best, top.schema)), "id")
    summary = text.excerpt(F.col("description"), F.col("short_description"), excerpt_chars)
    shown = [c for c in model.HIT_COLUMNS if c in documents.columns and "description" not in c]
    return hits.select(
        *shown, summary.text.alias("excerpt"), summary.truncated.alias("excerpt_truncated"), "score"
    ).orderBy(F.desc("score"), F.asc("id"))
