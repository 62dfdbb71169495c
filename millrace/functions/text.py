"""Text and label functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What makes a path vendored or generated: folders, endings, names of files that tools write.
VENDORED_FOLDERS = ["node_modules", "bower_components", "vendor", "third_party", "Pods", ".venv", "site-packages", "Carthage", "dist", "build", "out", "target", "bin", "obj", ".next", ".nuxt", "__pycache__", "__generated__", "generated", "gen", "coverage"]
VENDORED_ENDINGS = [".min.js", ".min.css", ".pb", ".pb.go", ".g.dart", ".g.cs", ".designer.cs", ".d.ts"]
LOCK_FILES = ["go.sum", "Cargo.lock", "composer.lock", "Gemfile.lock", "pnpm-lock.yaml", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "packages.lock.json", "gradle.lockfile", "mix.lock", "flake.lock"]
#: Endings of documents and of settings, and what categories are called.
DOCS_ENDINGS, CONFIG_ENDINGS = [".md", ".rst", ".adoc"], [".lock", ".yml", ".yaml", ".toml", ".cfg", ".ini"]
CATEGORY_NAMES = {"code": "Code", "test": "Tests", "config": "Configuration", "docs": "Documentation", "vendored": "Vendored / Generated"}
#: Names of issue types that are bugs, and of those that are known not to be.
BUG_TYPES = ["bug", "defect", "regression", "exception", "cosmetics", "usability problem", "performance problem"]
OTHER_TYPES = ["task", "sub-task", "subtask", "story", "user story", "epic", "improvement", "feature", "new feature", "meeting"]


def file_category(path: Column) -> Column:
    """vendored, test, docs, config or code: the first that a path is, whatever the case of its letters."""
    any_of = lambda words: "(" + "|".join(re.escape(w) for w in words) + ")"
    has = lambda pattern: path.rlike(f"(?i){pattern}")
    vendored = has(rf"(^|/){any_of(VENDORED_FOLDERS)}/") | has(rf"{any_of(VENDORED_ENDINGS)}$") | has(r"\.generated\.") | has(rf"(^|/){any_of(LOCK_FILES)}$")
    test = has(r"\.(spec|test)\.") | has("__tests__/") | has("(^|/)tests?/")
    docs = has(rf"{any_of(DOCS_ENDINGS)}$") | has("(^|/)docs/")
    return F.when(vendored, "vendored").when(test, "test").when(docs, "docs").when(has(rf"{any_of(CONFIG_ENDINGS)}$"), "config").otherwise("code")


def issue_kind(name: Column) -> Column:
    """bug, other or unknown, by the most stable name that an issue type has."""
    normal = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(normal.isin(BUG_TYPES), "bug").when(normal.isin(OTHER_TYPES), "other").otherwise("unknown")


def file_extension(path: Column) -> Column:
    """What follows the last dot of the base name, in lower case; empty for none and for names that only begin with a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO 8601 duration of hours, minutes and seconds; absent parts count as 0."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(text.isNotNull(), part("H") * 3600 + part("M") * 60 + part("S"))


def contains_ignoring_case(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def segment_match(source: Column, wanted: str) -> Column:
    """Whether `wanted` begins at a segment of the source name, dashes and underscores being the same."""
    return F.contains(F.concat(F.lit("_"), F.replace(source, F.lit("-"), F.lit("_"))), F.lit("_" + wanted.replace("-", "_")))


def like_escaped(part: str) -> str:
    """A LIKE pattern, with escape character !, that finds the part as it is."""
    return "%" + part.replace("!", "!!").replace("%", "!%").replace("_", "!_") + "%"


def csv_safe(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: a quote goes before the signs that begin one, and before blanks."""
    return F.when(text.rlike("^[=+\\-@\\t\\r\\n ]"), F.concat(F.lit("'"), text)).otherwise(text)


def lookup(value: Column, names: dict[str, str]) -> Column:
    """The label of a value; the value itself where the table has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), value)


def clamp(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """value within bounds; null stays null, which greatest and least alone would not keep."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(value.isNotNull(), out)
