"""Bulk bodies: newline-delimited JSON in pairs of an action line and a document line."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import DATE_TEXT


def parse_ndjson(body: str, index: str | None = None) -> list[dict]:
    """Items ``{index, _id, doc}`` of a body in order; any verb indexes, unreadable documents are skipped.

    The id comes from the action, else from the document's ``_id`` or ``_doc_id``, else it is new. A document wrapped
    in ``_source`` is unwrapped.
    """
    lines = [x for x in body.splitlines() if x.strip()]
    items, i = [], 0
    while i + 1 < len(lines):
        action, text = lines[i], lines[i + 1]
        i += 2
        try:
            head, doc = json.loads(action), json.loads(text)
        except json.JSONDecodeError:
            continue
        if not isinstance(doc, dict) or not isinstance(head, dict):
            continue
        meta = next(iter(head.values()), {})
        meta = meta if isinstance(meta, dict) else {}
        if isinstance(doc.get("_source"), dict):
            doc = {**{k: v for k, v in doc.items() if k in ("_id", "_doc_id")}, **doc["_source"]}
        own = [x for x in (meta.get("_id"), doc.pop("_id", None), doc.pop("_doc_id", None)) if x is not None]
        items.append({"index": meta.get("_index", index), "_id": str(own[0]) if own else str(uuid.uuid4()), "doc": doc})
    return items


def bulk_rows(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The same from files, distributed: ``_at, _id, _source`` of every pair of lines.

    Each file is a body of its own. Files are split like any text: lines are numbered within their split, splits by
    running sums over one row each, and the two lines of a pair meet by number. New ids follow from ``batch`` and the
    place, so a task that runs again gives the same ones.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("m"), "value").where(F.trim(F.col("value")) != "")
    within = Window.partitionBy("file", "split").orderBy("m")
    lines = lines.withColumn("n", F.row_number().over(within) - 1)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("size"))
    before = Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("size").over(by_file), F.lit(0)).alias("in_file"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("in_all"))
    placed = lines.join(splits, ["file", "split"]).select("file", (F.col("in_file") + F.col("n")).alias("line"), (F.col("in_all") + F.col("n")).alias("at"), "value")
    odd = F.col("line") % 2 == 1
    pairs = placed.groupBy("file", F.floor(F.col("line") / 2).alias("pair")).agg(F.min("at").alias("_at"), F.max(F.when(~odd, F.col("value"))).alias("action"), F.max(F.when(odd, F.col("value"))).alias("doc"))
    doc = F.col("doc")
    meta = F.from_json("action", "map<string,struct<_id:string,_index:string>>")
    from_action = F.get(F.map_values(meta), F.lit(0))["_id"]
    inner = F.get_json_object(doc, "$._source")
    source = F.when(inner.startswith("{"), inner).otherwise(doc)
    fields = F.map_filter(F.from_json(source, "map<string,variant>"), lambda k, v: ~k.isin("_id", "_doc_id"))
    rows = pairs.where(doc.isNotNull() & meta.isNotNull() & F.get_json_object(doc, "$").startswith("{"))
    new = F.sha2(F.concat_ws("|", F.lit(batch), "file", F.col("pair").cast("string")), 256).substr(1, 32)
    own: Column = F.coalesce(from_action, F.get_json_object(doc, "$._id"), F.get_json_object(doc, "$._doc_id"), new)
    return rows.select("_at", own.alias("_id"), F.to_json(fields).alias("_source"))


def learned(rows: DataFrame) -> dict[str, str]:
    """The mapped types of the fields in ``_source``, from one aggregate: what all values of a field have in common."""
    found = rows.agg(F.expr("schema_of_variant_agg(try_parse_json(_source))").alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return {}
    kinds: dict[str, str] = {}
    strings = []
    for name, kind in _fields(found[len("OBJECT<") : -1]):
        if kind in ("BIGINT", "INT", "SMALLINT", "TINYINT"):
            kinds[name] = "integer"
        elif kind.startswith(("DECIMAL", "DOUBLE", "FLOAT")):
            kinds[name] = "integer" if kind.startswith("DECIMAL") and kind.endswith(",0)") else "float"
        elif kind == "BOOLEAN":
            kinds[name] = "boolean"
        elif kind.startswith("ARRAY<") and kind[6:].startswith(("BIGINT", "INT", "DECIMAL", "DOUBLE", "FLOAT")):
            kinds[name] = "knn_vector"
        elif kind in ("STRING", "VARIANT"):
            kinds[name] = "text"
            strings.append(name)
    if strings:
        paths = {n: "$['" + n.replace("'", "\\'") + "']" for n in strings}
        dates = rows.agg(*(F.bool_and(F.get_json_object("_source", paths[n]).rlike(DATE_TEXT)).alias(f"d{i}") for i, n in enumerate(strings))).first()
        kinds |= {n: "date" for i, n in enumerate(strings) if dates[f"d{i}"]}
    return kinds


def _fields(text: str) -> list[tuple[str, str]]:
    """Names and types of ``a: T, b: U<...>``."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(text + ","):
        quoted ^= c == "`"
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth and not quoted:
            name, _, kind = text[start:i].strip().rpartition("`: ") if "`: " in text[start:i] else text[start:i].strip().partition(": ")
            if name:
                out.append((name.strip("`").replace("``", "`"), kind.strip()))
            start = i + 1
    return out
