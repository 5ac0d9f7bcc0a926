"""Import specifiers to files: relative, alias and namespace resolution as joins over tables of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflens.functions import paths
from difflens.operators.chunking import by_merge

#: What is tried after a specifier, in this order; again under /index.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".svelte")


#: What import statements look like.
FROM, SIDE_EFFECT = r"\bfrom\s*['\"]([^'\"]+)['\"]", r"(?:^|[\n;])\s*import\s*['\"]([^'\"]+)['\"]"
SCRIPT = r"<script[^>]*>([\s\S]*?)</script>"
USING, NAMESPACE = r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*;", r"(?m)^\s*namespace\s+([A-Za-z_][A-Za-z0-9_.]*)\s*[;{]"
MODULES = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")


def extract(sources: DataFrame) -> DataFrame:
    """range_id, path, kind (specifier or namespace), specifier: what sources (range_id, path, text) import or declare, copies included.

    Modules: `from '…'` and `import '…'`; Svelte: the same within its scripts; C#: `using`, and the namespaces it declares; other files: nothing.
    """
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    kind, text = paths.extension(F.col("path")), F.col("text")
    code = F.when(kind == "svelte", F.array_join(every(text, SCRIPT), "\n")).otherwise(text)
    tagged = lambda names, tag: F.transform(names, lambda s: F.struct(F.lit(tag).alias("kind"), s.alias("specifier")))
    module = tagged(F.concat(every(code, FROM), every(code, SIDE_EFFECT)), "specifier")
    sharp = F.concat(tagged(every(text, USING), "specifier"), tagged(every(text, NAMESPACE), "namespace"))
    found = F.when(kind == "cs", sharp).when(kind.isin("svelte", *MODULES), module)
    return sources.select("range_id", "path", F.explode(found).alias("s")).select("range_id", "path", "s.*")


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """range_id, path, specifier, target: the first of the path itself, with extensions, as index that is a file (range_id, path)."""
    plain = paths.normalize(F.concat_ws("/", paths.dirname(F.col("path")), "specifier"))
    tries = F.array(plain, *[F.concat(plain, F.lit(x)) for x in EXTENSIONS], *[F.concat(plain, F.lit(f"/index{x}")) for x in EXTENSIONS])
    d = imports.where(F.col("specifier").startswith(".")).select("range_id", "path", "specifier", F.posexplode(tries).alias("rank", "target"))
    known = files.select("range_id", F.col("path").alias("target")).distinct()
    return by_merge(d).join(known, ["range_id", "target"]).groupBy("range_id", "path", "specifier").agg(F.min_by("target", "rank").alias("target"))


def resolve_alias(imports: DataFrame, files: DataFrame) -> DataFrame:
    """range_id, path, specifier, target: `$x/a/b` to the only file whose path ends in a/b, both without code extensions."""
    rest = F.slice(F.split("specifier", "/"), F.lit(2), F.size(F.split("specifier", "/")))
    d = imports.where(F.col("specifier").startswith("$") & (F.size(rest) >= 2)).withColumn("suffix", paths.strip_code_extensions(F.array_join(rest, "/")))
    parts = F.split(paths.strip_code_extensions(F.col("path")), "/")
    ends = files.select("range_id", F.col("path").alias("target"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))
    met = d.join(by_merge(ends), ["range_id", "suffix"]).groupBy("range_id", "path", "specifier").agg(F.min("target").alias("target"), F.count_distinct("target").alias("n"))
    return met.where("n = 1").drop("n")


def import_graph(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (range_id, src, dst; distinct, no self-edges), and range_id, unresolved: specifiers without a target."""
    found = resolve_relative(imports, files).unionByName(resolve_alias(imports, files))
    edges = found.where("path <> target").select("range_id", F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    left = imports.join(found.select("range_id", "path", "specifier"), ["range_id", "path", "specifier"], "left_anti")
    return edges, left.groupBy("range_id").agg(F.count("*").alias("unresolved"))


def roles(files: DataFrame, edges: DataFrame) -> DataFrame:
    """range_id, path, role: low-signal, test, periphery (unconnected) or impl. files: range_id, path, low_signal."""
    ends = edges.select("range_id", F.col("src").alias("path")).union(edges.select("range_id", "dst")).distinct().withColumn("linked", F.lit(True))
    role = F.when(F.col("low_signal"), "low-signal").when(paths.is_test(F.col("path")) | paths.is_e2e(F.col("path")), "test").when(F.col("linked").isNull(), "periphery").otherwise("impl")
    return files.join(ends, ["range_id", "path"], "left").select("range_id", "path", role.alias("role"))


def import_lists(edges: DataFrame) -> DataFrame:
    """range_id, path, imports, imported_by: sorted arrays."""
    out = edges.groupBy("range_id", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    into = edges.groupBy("range_id", F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return out.join(into, ["range_id", "path"], "full_outer").select("range_id", "path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))
