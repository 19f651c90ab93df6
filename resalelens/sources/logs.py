"""Items reported in free text, as fenced JSON blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ITEM_FIELDS = (
    "title: STRING, lot: STRING, site: STRING, url: STRING, bid: DOUBLE, market_value: DOUBLE, "
    "profit: DOUBLE, pickup: STRING, ends: STRING, photos: ARRAY<STRING>"
)
_OBJECT = f"STRUCT<items: ARRAY<STRUCT<{ITEM_FIELDS}>>>"
_LIST = f"ARRAY<STRUCT<{ITEM_FIELDS}>>"

# The first fenced block that holds an object, and one that holds a list.
FENCED_OBJECT = r"(?s)```json\s*(\{.*?\})\s*```"
FENCED_LIST = r"(?s)```json\s*(\[.*?\])\s*```"


def extract_items(texts: DataFrame) -> DataFrame:
    """Items of each text's first block: an object's ``items``, or a bare list.

    ``texts`` has ``run_id, text``. Texts without a block, or with one that does not
    parse, give no rows.
    """
    as_object = F.regexp_extract("text", FENCED_OBJECT, 1)
    as_list = F.regexp_extract("text", FENCED_LIST, 1)
    items = F.when(as_object != "", F.from_json(as_object, _OBJECT)["items"]).otherwise(
        F.from_json(as_list, _LIST))
    return (
        texts.select("run_id", F.posexplode(items).alias("pos", "item"))
        .select("run_id", "pos", "item.*")
    )


# Any fenced block of an object or a list, up to the fence that ends it.
FENCED = r"(?s)```json\s*([\[{].*?[\]}])\s*```"
_FIELDS = [part.split(": ", 1) for part in ITEM_FIELDS.split(", ")]


def all_items(texts: DataFrame) -> DataFrame:
    """Items of all blocks of each text: ``run_id, block, pos, error, mistyped``, the item's
    fields and ``item``, the whole of it as a VARIANT, so that fields of no known name stay.

    A field of another type than its own is null and named in ``mistyped``. What gives no
    item is a row with an ``error`` instead: a block that is no JSON (``not json``), one
    that is neither a list nor an object with a list ``items`` (``no list``), an entry that is
    no object (``not an object``). ``block`` and ``pos`` count from 0. Empty lists and
    texts without a block give no rows.
    """
    blocks = texts.select("run_id", F.posexplode(F.regexp_extract_all("text", F.lit(FENCED), F.lit(1))).alias("block", "_text"))
    parsed = blocks.withColumn("_json", F.try_parse_json("_text")).withColumn("_list", F.coalesce(
        F.try_variant_get("_json", "$", "array<variant>"), F.try_variant_get("_json", "$.items", "array<variant>")))
    bad = F.when(F.col("_json").isNull(), "not json").when(F.col("_list").isNull(), "no list")
    # A block without a list is one row; so is each entry of the others.
    one = F.array(F.lit(None).cast("variant"))
    rows = parsed.select(
        "run_id", "block", bad.alias("_bad"), F.posexplode(F.coalesce("_list", one)).alias("pos", "item"))
    is_object = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    error = F.coalesce(F.col("_bad"), F.when(~is_object, "not an object"))
    fields = [F.try_variant_get("item", f"$.{name}", kind.lower()).alias(name) for name, kind in _FIELDS]
    read = rows.select("run_id", "block", "pos", error.alias("error"), "item", *fields)
    raw = {name: F.try_variant_get("item", f"$.{name}", "variant") for name, _ in _FIELDS}
    lost = [F.when(F.col(n).isNull() & v.isNotNull() & ~F.is_variant_null(v), n) for n, v in raw.items()]
    mistyped = F.array_compact(F.array(*lost))
    return read.withColumn("mistyped", F.when(F.col("error").isNull(), mistyped))
