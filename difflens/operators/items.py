"""Small rules over chunks, replies, reviews and jobs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most tokens and the fewest story items of an order job.
MOST_TOKENS, FEWEST_ITEMS = 32000, 3


def chunk_title(path: Column, start: Column, end: Column, file: Column) -> Column:
    """The symbol path, else the line range, else the file."""
    lines = F.concat(F.lit("lines "), start.cast("string"), F.lit("–"), end.cast("string"))
    return F.coalesce(F.when(F.size(path) > 0, F.array_join(path, ".")), lines, file)


def chunk_id(file: Column, path: Column, fingerprint: Column) -> Column:
    return F.concat_ws("::", file, F.array_join(path, "."), fingerprint)


def elapsed_seconds(created: Column, now: Column) -> Column:
    """Whole seconds since `created` (text); 0 for the future and for what is no time."""
    then = F.unix_seconds(F.try_to_timestamp(created))
    return F.coalesce(F.greatest(F.unix_seconds(now) - then, F.lit(0)), F.lit(0)).cast("long")


def _kind(reply: Column, path: str) -> Column:
    """The JSON type at a path; null if nothing is there."""
    return F.schema_of_variant(F.try_variant_get(reply, path, "variant"))


def usage(envelope: Column) -> Column:
    """input_tokens, output_tokens, cost of a JSON envelope; null unless both counts are numbers."""
    v = F.try_parse_json(envelope)
    number = lambda path: F.coalesce(_kind(v, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    whole, cost = ("$.usage.input_tokens", "$.usage.output_tokens"), "$.total_cost_usd"
    told = F.struct(*(F.try_variant_get(v, p, "long").alias(p.split(".")[-1]) for p in whole), F.when(number(cost), F.try_variant_get(v, cost, "double")).alias("cost"))
    return F.when(number(whole[0]) & number(whole[1]), told)


def reply_error(reply: Column, known: Column) -> Column:
    """Why a reply can't be used, null if it can: an object with a string `intro` and, if there, an object `chunks` of strings by known ids."""
    v = F.try_parse_json(reply)
    chunks = F.try_variant_get(v, "$.chunks", "map<string,variant>")
    return (
        F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "no object")
        .when(~F.coalesce(_kind(v, "$.intro") == "STRING", F.lit(False)), "no intro")
        .when(~F.coalesce(_kind(v, "$.chunks").startswith("OBJECT"), F.lit(True)), "no chunks object")
        .when(F.exists(F.map_keys(chunks), lambda k: ~F.array_contains(known, k)), "unknown chunk")
        .when(F.exists(F.map_values(chunks), lambda x: F.schema_of_variant(x) != "STRING"), "line is no string")
    )


def order_decision(overlay: Column, applied: Column, dismissed: Column, started: Column) -> Column:
    """overlay: whether there is one; started: whether a chunk is reviewed."""
    return F.when(~overlay, "none").when(applied, "apply").when(dismissed, "none").when(F.coalesce(started, F.lit(False)), "offer").otherwise("apply")


def glyph_class(state: Column, auto_read: Column) -> Column:
    held = F.coalesce(state, F.lit("unseen"))
    return F.when(F.coalesce(auto_read, F.lit(False)) & (held != "reviewed"), "auto").otherwise(held)


#: The settings of a story and the pair that selects file mode.
DIRECTIONS, PLACEMENTS, FILE_MODE = ("consumer-first", "dependency-first"), ("before", "after", "end"), "dependency-first/after"


def story_config(raw: Column, base_direction: Column, base_placement: Column) -> Column:
    """direction, placement, key, file_mode of a JSON text over a base; values that aren't known leave the base's."""
    told = lambda path, known, base: F.when(F.get_json_object(raw, path).isin(*known), F.get_json_object(raw, path)).otherwise(base)
    direction, placement = told("$.direction", DIRECTIONS, base_direction), told("$.testPlacement", PLACEMENTS, base_placement)
    key = F.concat_ws("/", direction, placement)
    return F.struct(direction.alias("direction"), placement.alias("placement"), key.alias("key"), (key == FILE_MODE).alias("file_mode"))
