"""Column expressions over paths and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of lock files and extensions of configuration formats.
LOCKFILES = ("bun.lock", "bun.lockb", "cargo.lock", "composer.lock", "deno.lock", "flake.lock", "gemfile.lock", "go.sum", "npm-shrinkwrap.json", "package-lock.json", "packages.lock.json", "paket.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock")
CONFIG_EXTENSIONS = ("config", "csproj", "json", "lock", "props", "resx", "targets", "toml", "xml", "yaml", "yml")
CODE_EXTENSION = r"(\.(ts|tsx|js|jsx|mjs|cjs|svelte))+$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """The lower-case base name up to its last dot, which isn't its first character."""
    return F.lower(F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def normalize(path: Column) -> Column:
    """Without `.` and `..` segments; `..` above the root does nothing."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def strip_code_extensions(path: Column) -> Column:
    return F.regexp_replace(path, CODE_EXTENSION, "")


def ancestor_namespaces(name: Column) -> Column:
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def is_test(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(tests?|__tests__)/") | basename(path).rlike(r"\.(test|spec)\.|Tests?\.cs$")


def is_e2e(path: Column) -> Column:
    return path.rlike(r"(?i)(^|/)(e2e|playwright)/") | basename(path).rlike(r"\.e2e\.")


def is_route(path: Column) -> Column:
    return path.rlike(r"(^|/)(routes|pages)/") | basename(path).rlike(r"^\+(page|layout)|Controller\.cs$")


def is_config(path: Column) -> Column:
    return extension(path).isin(*CONFIG_EXTENSIONS)


def generated_reason(path: Column, head: Column) -> Column:
    """Why a file counts as generated (first match), else null. head: its first five lines, joined."""
    name = F.lower(basename(path))
    rules = [
        (name.isin(*LOCKFILES), "lockfile"),
        (name.endswith("modelsnapshot.cs"), "migration snapshot"),
        (name.rlike(r"\.(g|generated|designer)\.(cs|ts|js)$"), "generated"),
        (name.rlike(r"\.min\.(js|mjs|css)$|\.map$"), "minified"),
        (name.endswith(".snap") | path.rlike("(^|/)__snapshots__/"), "snapshot"),
        (name.endswith(".po") & ~name.rlike(r"^en([-_][a-z0-9]+)?\.po$"), "translations"),
        (F.lower(dirname(path)).rlike(r"(^|[-_./])generated([-_./]|$)"), "generated"),
        (F.lower(head).rlike(r"<auto-generated|@generated|\bgenerated by\b|do not edit"), "generated"),
    ]
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))


def repo_id(origin: Column, path: Column, root_sha: Column) -> Column:
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.coalesce(origin, path), "/+$", ""), "[/:]"), -1), r"\.git$", "")
    return F.concat_ws("-", F.regexp_replace(last, r"[^\w.-]", "-"), F.substring(root_sha, 1, 12))


def files_changed_url(url: Column) -> Column:
    plain = F.regexp_replace(url, "/+$", "")
    return F.when(plain.rlike(r"/pull/\d+$"), F.concat(plain, F.lit("/files")))
