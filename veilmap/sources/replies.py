"""Tolerant parsing of model replies, with a quarantine for what cannot be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a fenced block, optionally marked json.
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"


def _object(candidate: Column, schema: str) -> Column:
    """The parsed object, or null unless the text is exactly one well-formed JSON object.

    A JSON reader stops after the first value. Wrapping the text once as an
    array element and once as a field makes anything that follows an error.
    """
    text = F.regexp_replace(candidate, r"^\s+|\s+$", "")
    fields = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(schema).fields)
    element = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{fields}>>", {"mode": "PERMISSIVE"})
    field = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v struct<{fields}>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # Nested, so that text without braces is never parsed.
    return F.when(text.startswith("{") & text.endswith("}"), F.when((F.size(element) == 1) & field["_bad"].isNull(), field["v"]))


def read_object(text: str, schema: str) -> Column:
    """The first JSON object of a reply, else null.

    Tried in order: the whole reply, each fenced block, the span from the
    first { to the last }. Arrays and scalars are not accepted.
    """
    t = F.col(text)
    start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
    span = F.when((start > 0) & (F.instr(t, "}") > 0) & (start < end), F.substring(t, start, end - start + 1))
    blocks = F.when(F.instr(t, "```") > 0, F.regexp_extract_all(t, F.lit(FENCE), F.lit(1)))
    fenced = F.filter(F.transform(blocks, lambda b: _object(b, schema)), lambda o: o.isNotNull())
    return F.coalesce(_object(t, schema), F.try_element_at(fenced, F.lit(1)), _object(span, schema))


def parse_replies(df: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``parsed``, rejected rows)."""
    out = df.withColumn("parsed", read_object(text, schema))
    return out.where(F.col("parsed").isNotNull()), out.where(F.col("parsed").isNull()).drop("parsed")


def split_cues(df: DataFrame, text: str, *, keys=("subject_id",)) -> tuple[DataFrame, DataFrame]:
    """(cue rows, rejected elements) of replies that are JSON arrays.

    Every element is read by itself: one that is no object, or has no name or no four numeric box values, is rejected
    with its text and a reason and takes no other with it. A reply that is no array is rejected as a whole (pos null).
    Category defaults to 'other', confidence to 0.
    """
    fields = "name:string,cue:string,bbox:array<string>,category:string,segment_query:string,reasoning:string,confidence:string"
    parsed = df.select(*keys, F.col(text).alias("element"), F.expr(f"try_variant_get(try_parse_json(`{text}`), '$', 'array<variant>')").alias("__a"))
    whole = parsed.where(F.col("__a").isNull()).select(*keys, F.lit(None).cast("int").alias("pos"), "element", F.lit("no array").alias("reason"))
    each = parsed.where(F.col("__a").isNotNull()).select(*keys, F.posexplode("__a").alias("pos", "__v"))
    is_object = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    each = each.withColumn("element", F.to_json("__v")).withColumn("e", F.when(is_object, F.from_json("element", f"struct<{fields}>")))
    box = F.transform("e.bbox", lambda v: v.try_cast("double"))
    name = F.coalesce(F.nullif(F.col("e.name"), F.lit("")), F.nullif(F.col("e.cue"), F.lit("")))
    rows = each.select(
        *keys, "pos", "element", F.col("e").isNotNull().alias("__object"), name.alias("cue"), F.coalesce("e.category", F.lit("other")).alias("category"),
        box.alias("bbox"), F.trim(F.coalesce("e.segment_query", F.lit(""))).alias("segment_query"), F.coalesce("e.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce(F.col("e.confidence").try_cast("double"), F.lit(0.0)).alias("confidence"),
    )
    boxed = F.coalesce((F.size("bbox") == 4) & ~F.exists("bbox", lambda v: v.isNull()), F.lit(False))
    reason = F.when(~F.col("__object"), "no object").when(F.col("cue").isNull(), "no name").when(~boxed, "no box")
    rows = rows.withColumn("reason", reason)
    kept = rows.where(F.col("reason").isNull()).drop("reason", "element", "__object").withColumn("is_text", F.col("category") == "text/signage")
    return kept, rows.where(F.col("reason").isNotNull()).select(*keys, "pos", "element", "reason").unionByName(whole)


def parse_cues(df: DataFrame, text: str, *, keys=("subject_id",)) -> DataFrame:
    """The cue rows alone."""
    return split_cues(df, text, keys=keys)[0]
