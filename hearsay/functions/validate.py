"""P4-P6 message validation on JSON text, as column expressions.

P5 follows JSON-Schema semantics for the post schema: a missing required property is reported
before any property type error, and only the first problem is reported (the reference raises
on the first). JSON types come from ``schema_of_variant`` over ``parse_json``; a key that is
absent gives SQL NULL, a JSON null gives ``VOID``. Messages are short forms of the validator's
first line: ``'author' is a required property`` / ``author is not of type 'string'``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the post schema (property, allowed JSON types) in declaration order, and its
# required properties in order.
POST_SCHEMA = [
    ("id", ["string"]), ("title", ["string"]), ("selftext", ["string", "null"]), ("author", ["string"]),
    ("subreddit", ["string"]), ("created_utc", ["string"]), ("score", ["integer", "null"]),
    ("num_comments", ["integer", "null"]), ("url", ["string", "null"]), ("permalink", ["string", "null"]),
    ("upvote_ratio", ["number", "null"]), ("is_self", ["boolean", "null"]), ("link_flair_text", ["string", "null"]),
]
SCHEMA_REQUIRED = ["id", "title", "author", "created_utc", "subreddit"]
COMPLETENESS_FIELDS = ["id", "title", "author", "created_utc", "subreddit"]


def json_kind(type_name: Column) -> Column:
    """Map a variant type name to a JSON-Schema type ('integer' for whole numbers)."""
    t = F.upper(type_name)
    return (F.when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null")
            .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | t.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
            .when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("other"))


def schema_errors(value: Column) -> Column:
    v = F.try_parse_json(value)
    checks = []
    for f in SCHEMA_REQUIRED:
        checks.append(F.when(F.variant_get(v, f"$.{f}", "variant").isNull(), F.lit(f"'{f}' is a required property")))
    for f, allowed in POST_SCHEMA:
        kind = json_kind(F.schema_of_variant(F.variant_get(v, f"$.{f}", "variant")))
        ok = kind.isin(*allowed) | (kind == "integer") & F.lit("number" in allowed)
        checks.append(F.when(F.variant_get(v, f"$.{f}", "variant").isNotNull() & ~ok,
                             F.lit(f"{f} is not of type '{'|'.join(a for a in allowed if a != 'null')}'")))
    first = F.coalesce(*checks)
    not_object = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("instance is not of type 'object'"))
    err = F.coalesce(not_object, first)
    return F.when(err.isNull(), F.array().cast("array<string>")).otherwise(F.array(err))


def validate(value: Column) -> Column:
    """P5: struct<is_valid, errors>."""
    e = schema_errors(value)
    return F.struct((F.size(e) == 0).alias("is_valid"), e.alias("errors"))


def missing_fields(value: Column, fields: list[str] | None = None) -> Column:
    """Fields absent, null or '' in the message."""
    hits = []
    for f in fields or COMPLETENESS_FIELDS:
        x = F.get_json_object(value, f"$.{f}")
        hits.append(F.when(x.isNull() | (x == ""), F.lit(f)))
    return F.array_compact(F.array(*hits))
