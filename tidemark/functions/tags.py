"""Closed-vocabulary tags: normalise, filter, cap, and ground in the text.

The vocabulary is curated by people and small, so it travels inside the plan as a literal map.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import WHITE_SPACE
from tidemark.session import small_frame


@dataclass(frozen=True)
class Theme:
    slug: str
    label: str
    description: str


@dataclass(frozen=True)
class Vocabulary:
    """Canonical tags by category, aliases (lower case) to canonical tags, and themes."""

    categories: dict[str, tuple[str, ...]]
    aliases: dict[str, str]
    themes: tuple[Theme, ...]
    max_themes: int = 3

    @property
    def canonical(self) -> list[str]:
        return [tag for tags in self.categories.values() for tag in tags]

    @property
    def lookup(self) -> dict[str, str]:
        """Lower-case spelling to canonical tag; an alias wins over a canonical spelling."""
        return {tag.lower(): tag for tag in self.canonical} | self.aliases

    @property
    def surface_forms(self) -> dict[str, list[str]]:
        """Every lower-case form to look for in a text, with the tags it stands for."""
        forms: dict[str, list[str]] = {}
        for form, tag in [(t.lower(), t) for t in self.canonical] + list(self.aliases.items()):
            tags = forms.setdefault(form, [])
            if tag not in tags:
                tags.append(tag)
        return forms

    def theme(self, slug: str) -> Theme:
        for theme in self.themes:
            if theme.slug == slug:
                return theme
        raise ValueError(f"unknown theme: {slug}")


def build_vocabulary(data: dict, theme_bounds: tuple[int, int] = (30, 50)) -> Vocabulary:
    """Check a vocabulary document and resolve it; every inconsistency raises ``ValueError``."""
    categories = {name: tuple(map(str, tags)) for name, tags in data["canonical"].items()}
    canonical = [tag for tags in categories.values() for tag in tags]
    aliases = {str(k).lower(): str(v) for k, v in (data.get("aliases") or {}).items()}
    themes = tuple(Theme(t["slug"], t["label"], t["description"]) for t in data["themes"])
    slugs = [t.slug for t in themes]
    if len(set(canonical)) < len(canonical):
        raise ValueError("a canonical tag is listed twice")
    if stray := sorted(set(aliases.values()) - set(canonical)):
        raise ValueError(f"aliases of unknown tags: {stray}")
    if len(set(slugs)) < len(slugs):
        raise ValueError("a theme slug is listed twice")
    low, high = theme_bounds
    if not low <= len(themes) <= high:
        raise ValueError(f"{len(themes)} themes, expected {low} to {high}")
    return Vocabulary(categories, aliases, themes, int(data.get("max_per_project", 3)))


def load_vocabulary(path: str | Path, theme_bounds: tuple[int, int] = (30, 50)) -> Vocabulary:
    return build_vocabulary(json.loads(Path(path).read_text(encoding="utf-8")), theme_bounds)


def theme_frame(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    rows = [(t.slug, t.label, t.description) for t in vocabulary.themes]
    columns = [T.StructField(c, T.StringType()) for c in ("slug", "label", "description")]
    return small_frame(spark, rows, T.StructType(columns))


def _literal_map(entries: dict) -> Column:
    pairs = [F.lit(part) for entry in entries.items() for part in entry]
    return F.create_map(*pairs)


def _spelling(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(WHITE_SPACE)))


def normalize_tag(c: Column, vocabulary: Vocabulary) -> Column:
    """Canonical tag of any known spelling, NULL outside the vocabulary."""
    return F.try_element_at(_literal_map(vocabulary.lookup), _spelling(c))


def clean_tags(tags: Column, vocabulary: Vocabulary) -> Column:
    """Known tags only, canonical, without repeats, in first-seen order."""
    known = F.transform(tags, lambda t: normalize_tag(t, vocabulary))
    return F.array_distinct(F.array_compact(known))


def clean_themes(slugs: Column, vocabulary: Vocabulary) -> Column:
    """Known themes only, without repeats, at most ``max_themes`` of them."""
    allowed = [t.slug for t in vocabulary.themes]
    known = F.filter(F.transform(slugs, _spelling), lambda s: s.isin(allowed))
    return F.slice(F.array_distinct(known), 1, vocabulary.max_themes)


def mentioned_tags(text: Column, vocabulary: Vocabulary) -> Column:
    """Tags of which some form occurs in the text between non-alphanumeric characters.

    Plain forms are looked up among the text's tokens, so their number does not matter. Only forms
    with spaces or symbols cost one constant pattern each.
    """
    lowered = F.lower(text)
    plain, patterned = {}, {}
    for form, tags in vocabulary.surface_forms.items():
        (plain if re.fullmatch("[a-z0-9]+", form) else patterned)[form] = tags
    found = [
        F.when(
            lowered.rlike(rf"(?<![a-z0-9])\Q{form}\E(?![a-z0-9])"), F.array(*map(F.lit, tags))
        ).otherwise(F.array().cast("array<string>"))
        for form, tags in patterned.items()
    ]
    if plain:
        tags_of = _literal_map({form: F.array(*map(F.lit, tags)) for form, tags in plain.items()})
        tokens = F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)))
        known = F.filter(tokens, lambda t: t.isin(list(plain)))
        found.append(F.flatten(F.transform(known, lambda t: F.try_element_at(tags_of, t))))
    return F.array_distinct(F.concat(*found))


def ground_tags(tags: Column, mentioned: Column) -> Column:
    """The tags that are mentioned, in their own order."""
    return F.filter(tags, lambda t: F.array_contains(mentioned, t))


def parse_tag_json(content: Column, vocabulary: Vocabulary) -> Column:
    """``struct(tech_stack, theme_tags)`` from a model's answer; a bad answer gives empty arrays."""
    answer = F.from_json(content, "tech_stack array<string>, theme_tags array<string>")
    nothing = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(clean_tags(answer.tech_stack, vocabulary), nothing).alias("tech_stack"),
        F.coalesce(clean_themes(answer.theme_tags, vocabulary), nothing).alias("theme_tags"),
    )
