"""Dependency names declared by build manifests."""

from __future__ import annotations

import tomllib
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where TOML manifests declare packages (and what stands there but is none), line patterns, and
# requirement lines that name no package.
TOML_SECTIONS = {
    "pyproject.toml": [(("project", "dependencies"), ()), (("tool", "poetry", "dependencies"), ("python",))],
    "Cargo.toml": [(("dependencies",), ())],
}
REQUIREMENT = r"\A\s*([A-Za-z0-9._-]+)"
GO_MODULE = r"(?U)\A\s*([\w./-]+)\s+v"
NOT_A_PACKAGE = r"\A(?:#|-|http://|https://|git\+)"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.trim(F.replace(line, F.lit("\t"), F.lit(" "))))


def _captured(lines: Column, pattern: str) -> Column:
    names = F.transform(lines, lambda line: F.regexp_extract(line, pattern, 1))
    return F.filter(names, lambda name: name != "")


def package_json_names(text: Column) -> Column:
    sections = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    nothing = F.array().cast("array<string>")
    return F.concat(
        F.coalesce(F.map_keys(sections.dependencies), nothing),
        F.coalesce(F.map_keys(sections.devDependencies), nothing),
    )


def requirements_names(text: Column) -> Column:
    return _captured(F.filter(_lines(text), lambda line: ~line.rlike(NOT_A_PACKAGE)), REQUIREMENT)


def go_module_names(text: Column) -> Column:
    return F.transform(_captured(_lines(text), GO_MODULE), lambda path: F.substring_index(path, "/", -1))


def _declared(manifest: str, text: str) -> list[str]:
    """Entries of the sections that name packages: keys of tables, items of lists."""
    try:
        tree = tomllib.loads(text)
    except ValueError:
        return []
    found = []
    for path, no_packages in TOML_SECTIONS[manifest]:
        section = reduce(lambda node, key: node.get(key) if isinstance(node, dict) else None, path, tree)
        entries = map(str, section) if isinstance(section, dict | list) else ()
        found.extend(entry for entry in entries if entry.lower() not in no_packages)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def toml_entries(manifest: pd.Series, text: pd.Series) -> pd.Series:
    """TOML has no native reader. Rows of other formats arrive as NULL and cost nothing."""
    return pd.Series([None if t is None else _declared(m, t) for m, t in zip(manifest, text)])


def toml_names(manifest: Column, text: Column) -> Column:
    """Names of the packages: an entry begins with one, a version or a marker may follow."""
    return _captured(toml_entries(manifest, F.when(manifest.isin(list(TOML_SECTIONS)), text)), REQUIREMENT)


def dependency_names(manifest: Column, text: Column) -> Column:
    """Names a manifest declares; an unknown manifest or a broken file declares none."""
    return F.coalesce(
        F.when(manifest == "package.json", package_json_names(text))
        .when(manifest == "requirements.txt", requirements_names(text))
        .when(manifest == "go.mod", go_module_names(text)),
        toml_names(manifest, text),
        F.array().cast("array<string>"),
    )


def decode_content(encoded: Column) -> Column:
    """Text of a base64 file body (line breaks allowed); bytes that are not UTF-8 are replaced."""
    return F.make_valid_utf8(F.unbase64(encoded).cast("string"))
