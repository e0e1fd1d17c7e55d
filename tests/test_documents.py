"""Writes, mappings, bulk bodies, dates, and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from findling import Catalog, Mapping
from findling.errors import DocumentMissing, IllegalArgument, IndexExists, IndexNotFound, StrictMapping
from findling.functions import date_from_text, round_half_away
from findling.mapping import check_index_name
from findling.sources import parse_ndjson


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/indices")


def test_names(catalog):
    for name in ("Upper", "_x", ".x", "a b", "", "a/b", "x" * 256):
        with pytest.raises(IllegalArgument):
            check_index_name(name)
    catalog.create("ok-1", {"t": "text"})
    with pytest.raises(IndexExists):
        catalog.create("ok-1")
    with pytest.raises(IndexNotFound):
        catalog.index("other")


def test_documents(catalog):
    index = catalog.create("books", {"title": "text", "year": "integer", "price": "float", "on": "date", "new": "boolean", "v": {"type": "knn_vector", "dimension": 2}})
    index.put({"title": "Red fox", "year": 7.9, "price": "3.5", "on": "2025-01-05T08:15:00+05:30", "new": True, "v": [1, 2]}, "1")
    index.put({"title": "Blue fox", "extra": {"deep": 1}}, "2")
    row = index.frame().where("_id = '1'").first()
    assert (row["year"], row["price"], row["new"], row["v"]) == (7, 3.5, True, [1.0, 2.0]) and str(row["on"]) == "2025-01-05 02:45:00"
    index.put({"title": "Green fox"}, "2")
    assert index.count() == 2 and index.count({"query": {"match": {"title": "green"}}}) == 1
    assert index.update("1", {"price": None, "note": "x"})["price"] is None
    assert index.get("1") == {"title": "Red fox", "year": 7.9, "price": None, "on": "2025-01-05T08:15:00+05:30", "new": True, "v": [1, 2], "note": "x"}
    with pytest.raises(DocumentMissing):
        index.update("9", {})
    assert index.delete("2") and not index.delete("2") and index.get("2") is None and index.count() == 1
    before = index.verify().count()
    index.compact()
    assert index.count() == 1 and index.verify().count() == 1 < before
    assert index.put({"title": "new"}) not in ("1", "2")
    again = Catalog(catalog.spark, catalog.root).create("books", {"title": "text"})
    assert again.count() == 2 and again.seq > 0
    catalog.drop("books")
    assert not catalog.exists("books")


def test_dynamic_modes(catalog):
    index = catalog.index("auto", create=True)
    index.put({"a": 1, "b": 1.5, "c": True, "d": "2025-02-03", "e": "word", "f": None, "g": {"x": 1}, "v": [0.5, 1]}, "1")
    assert index.mapping.fields == {"a": "integer", "b": "float", "c": "boolean", "d": "date", "e": "text", "v": "knn_vector"}
    fixed = catalog.create("fixed", {"properties": {"a": {"type": "integer"}}, "dynamic": "strict"})
    with pytest.raises(StrictMapping):
        fixed.put({"a": 1, "z": None})
    loose = catalog.create("loose", {"a": "integer"})
    loose.put({"a": 1, "z": "x"}, "1")
    assert loose.mapping.fields == {"a": "integer"}
    assert catalog.settings("loose", {"dynamic": "true"})["dynamic"] == "true"
    with pytest.raises(IllegalArgument):
        catalog.settings("loose", {"engine": "x"})


BODY = "\n".join(
    [
        '{"index": {"_id": "a"}}', '{"n": 1}',
        '{"create": {}}', '{"_id": "b", "n": 2}',
        '{"delete": {"_id": "c"}}', '{"_doc_id": "z", "n": 3}',
        '{"index": {"_id": "bad"}}', "{broken",
        '{"index": {"_id": "a"}}', '{"_source": {"n": 4}}',
        '{"index": {}}', '{"n": 5}',
    ]
)


def test_bulk(catalog, tmp_path):
    items = parse_ndjson(BODY)
    assert [i["_id"] for i in items][:4] == ["a", "b", "c", "a"] and len(items) == 5
    index = catalog.create("bulk", {"n": "integer"})
    assert [r["status"] for r in index.bulk(BODY).collect()] == [201] * 5
    assert {r["_id"]: r["n"] for r in index.frame().collect() if len(r["_id"]) == 1} == {"a": 4, "b": 2, "c": 3}
    (tmp_path / "body.ndjson").write_text(BODY)
    files = catalog.create("files", {"n": "integer"})
    files.bulk_files(f"file://{tmp_path}/body.ndjson")
    assert {r["_id"]: r["n"] for r in files.frame().collect() if len(r["_id"]) == 1} == {"a": 4, "b": 2, "c": 3} and files.count() == 4
    strict = catalog.create("strict", {"properties": {"m": {"type": "integer"}}, "dynamic": "strict"})
    assert {r["status"] for r in strict.bulk(BODY).collect()} == {400} and strict.count() == 0


def test_bulk_files_learn_and_pair_lines_across_splits(spark, catalog, tmp_path):
    lines = []
    for i in range(400):
        lines += [json.dumps({"index": {"_id": f"d{i % 300}"}}), json.dumps({"n": i, "name": f"boat {i}", "on": "2025-03-01", "_id": "ignored"}), "" if i % 3 else "  "]
    (tmp_path / "many.ndjson").write_text("\n".join(lines))
    index = catalog.create("learned", {"dynamic": "true"})
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        index.bulk_files(f"file://{tmp_path}/many.ndjson")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert index.mapping.fields == {"n": "integer", "name": "text", "on": "date"}
    assert {r["_id"]: r["n"] for r in index.frame().collect()} == {f"d{i}": i + 300 if i < 100 else i for i in range(300)}
    assert index.get("d7") == {"n": 307, "name": "boat 307", "on": "2025-03-01"}
    with pytest.raises(StrictMapping):
        catalog.create("narrow", {"properties": {"n": {"type": "integer"}}, "dynamic": "strict"}).bulk_files(f"file://{tmp_path}/many.ndjson")


def test_publish_learns_and_orders(spark, catalog):
    index = catalog.index("published", create=True)
    rows = [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "middle"), ("b", None, "only")]
    frame = spark.createDataFrame(rows, "k string, v long, word string").repartition(4)
    index.publish(frame, "k", order="v")
    assert index.mapping.fields == {"k": "text", "v": "integer", "word": "text"}
    assert sorted((r["_id"], r["word"]) for r in index.frame().collect()) == [("a", "new"), ("b", "only")]
    assert catalog.sql("SELECT _id FROM published WHERE word = 'new'").first()["_id"] == "a"
    index.update_all(spark.createDataFrame([("a", '{"v": null, "extra": [1, 2]}'), ("z", '{"v": 1}')], "_id string, patch string"))
    assert index.get("a") == {"k": "a", "v": None, "word": "new", "extra": [1, 2]} and index.get("z") is None and index.get("b")["word"] == "only"


def test_global_bulk(catalog):
    body = "\n".join(['{"index": {"_index": "one", "_id": "x"}}', '{"t": "red"}', '{"index": {"_index": "two"}}', '{"_id": 5, "t": 1}', '{"index": {"_index": "NO"}}', '{"t": 2}', '{"index": {"_index": "one", "_id": "x"}}', '{"t": "blue"}'])
    assert [tuple(r) for r in catalog.bulk(body).collect()] [:2] == [(0, "one", "x", 201), (1, "two", "5", 201)]
    assert catalog.bulk(body).where("status = 400").select("_index").collect()[0][0] == "NO"
    assert catalog.index("one").get("x") == {"t": "blue"} and catalog.index("two").get("5") == {"t": 1}
    assert {r["index"] for r in catalog.cat_segments().collect()} == {"one", "two"}


def test_a_catalog_knows_its_folder(spark, catalog):
    index = catalog.create("kept", {"properties": {"t": {"type": "text"}}, "dynamic": "true"})
    index.put({"t": "a red sail", "n": 4}, "1")
    again = Catalog(spark, catalog.root)
    assert again.known() == ["kept"] and again.index("kept").mapping.fields == {"t": "text", "n": "integer"}
    assert again.sql("SELECT n FROM kept WHERE t = 'sail'").first()["n"] == 4
    again.drop("kept")
    assert Catalog(spark, catalog.root).known() == []


def test_verify_and_compaction_that_breaks_off(spark, catalog, tmp_path, monkeypatch):
    index = catalog.create("safe", {"t": "text"})
    for i in range(3):
        index.put({"t": f"v{i}"}, "1")
    assert [r["status"] for r in index.verify().collect()] == ["ok"] * 3
    monkeypatch.setattr(index, "_commit", lambda: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        index.compact()
    monkeypatch.undo()
    after = Catalog(spark, catalog.root).index("safe")
    assert after.get("1") == {"t": "v2"} and after.verify().count() == 3
    after.compact()
    assert after.get("1") == {"t": "v2"} and [r["status"] for r in after.verify().collect()] == ["ok"]
    file = next((tmp_path / "indices" / "safe").glob("gen-*/b-*/part-*.parquet"))
    spark.createDataFrame([("1", 9, 0, False, '{"t": "forged"}')], "_id string, _seq long, _at long, _deleted boolean, _source string").coalesce(1).write.parquet(f"file://{tmp_path}/forged")
    file.write_bytes(next((tmp_path / "forged").glob("part-*.parquet")).read_bytes())
    file.with_name(f".{file.name}.crc").unlink()
    assert [r["status"] for r in Catalog(spark, catalog.root).index("safe").verify().collect()] == ["changed"]


def test_text_clauses_read_only_files_that_can_match(spark, tmp_path):
    from findling.sources import TermFiles

    rows = [(i, f"word{i} common {'rare' if i in (5, 25) else 'usual'}", i % 4) for i in range(40)]
    spark.createDataFrame(rows, "k long, t string, n long").repartitionByRange(8, "k").write.parquet(f"file://{tmp_path}/table")
    TermFiles(spark, f"file://{tmp_path}/terms").build(f"file://{tmp_path}/table", ["t"])
    catalog = Catalog(spark)
    index = catalog.register_files("table", f"file://{tmp_path}/table", ("t",), "k", f"file://{tmp_path}/terms")
    read = lambda df: len(df.inputFiles())
    cases = [("rare", 2, 2), ("common", 8, 40), ("rare AND word5", 1, 1), ("+rare -word5", 2, 1), ("word1 word39", 2, 2), ("-rare +usual", 8, 38), ("absent", 0, 0), ("rare OR k", 2, 2), ('"common rare"', 2, 2)]
    for text, files, hits in cases:
        df = catalog.sql(f"SELECT k FROM table WHERE text_match(t, '{text}') AND n >= 0")
        assert (read(df), df.count()) == (files, hits), text
    twice = catalog.sql("SELECT k FROM table WHERE text_match(t, 'rare') AND n IN (SELECT n FROM table WHERE k = 5)")
    assert sorted(r["k"] for r in twice.collect()) == [5, 25]
    found = index.search({"query": {"bool": {"filter": [{"term": {"t": "rare"}}], "must_not": [{"term": {"n": 3}}]}}, "sort": ["k"]})
    assert read(found.matched) == 2 and [r["k"] for r in found.hits.collect()] == [5, 25]
    assert index.count({"query": {"match": {"t": "rare"}}}) == 2
    assert len(index.search({"query": {"match": {"t": "rare"}}}).hits.collect()) == 2  # scored over the whole table
    spark.createDataFrame([(99, "rare again", 0)], "k long, t string, n long").write.mode("append").parquet(f"file://{tmp_path}/table")
    assert catalog.register_files("table", f"file://{tmp_path}/table", ("t",), "k", f"file://{tmp_path}/terms").count({"query": {"match": {"t": "rare"}}}) == 3


def test_dates_and_rounding(spark):
    texts = ["2025-01-05T08:15:00Z", "2025-01-05T08:15:00.5", "2025-01-05", "1736064900000", "2025-02-29", "2025", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(date_from_text(F.col("t")).cast("string")).collect()]
    assert got == ["2025-01-05 08:15:00", "2025-01-05 08:15:00.5", "2025-01-05 00:00:00", "2025-01-05 08:15:00", None, "1970-01-01 00:00:02.025", None, None]
    values = [r[0] for r in spark.createDataFrame([(x,) for x in (2.5, -2.5, 1.005, 0.0)], "x double").select(round_half_away(F.col("x"))).collect()]
    assert values == [3.0, -3.0, 1.0, 0.0]


def test_mapping_round_trip():
    body = {"dynamic": "strict", "properties": {"a": {"type": "text"}, "v": {"type": "knn_vector", "dimension": 3}}}
    assert Mapping.of(body).body() == body and json.loads(json.dumps(Mapping.of(body).schema().jsonValue()))
    with pytest.raises(IllegalArgument):
        Mapping.of({"a": "nested"})


def test_streams(spark, catalog, tmp_path):
    from findling.streaming import ingest_stream, session_counts, stateful_totals, tumbling_counts

    rows = [(i, f"2025-01-0{1 + i // 10} 0{i % 10}:00:00", i % 3, float(i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "event_id long, t string, user_id long, value double").withColumn("ts", F.to_timestamp("t"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    index = catalog.create("stream", {"user_id": "integer", "value": "float"})
    ingest_stream(stream, index, "event_id", f"{tmp_path}/check").awaitTermination()
    assert index.count() == 30

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    days = run(tumbling_counts(stream, "ts", "1 day", [], "value", late="1 hour"), "days", "complete")
    assert sorted(r["n"] for r in days.collect()) == [10, 10, 10]
    assert tumbling_counts(frame, "ts", "1 day", [], "value").count() == 3
    assert session_counts(frame, "ts", "2 hours", []).count() == 3
    totals = run(stateful_totals(stream), "totals", "update")
    assert {r["user_id"]: r["n"] for r in totals.collect()} == {0: 10, 1: 10, 2: 10}
