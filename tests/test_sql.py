"""SQL over the ship's log: values worked out by hand from the fixture."""

import json

import pytest

from findling.errors import AmbiguousColumn, GroupByText, IndexNotFound, ParsingError, SqlFailed

CASES = [
    ("SELECT count(*) AS n FROM voyages", [(12,)]),
    ("SELECT sum(miles) AS m, avg(miles) AS a FROM voyages", [(1203, 100.25)]),
    ("SELECT count(*) AS n FROM voyages WHERE text_match(log, 'storm')", [(3,)]),
    ("SELECT _id FROM voyages WHERE text_match(log, 'fog whales') ORDER BY _id", [("v03",), ("v05",), ("v11",)]),
    ("SELECT _id FROM voyages WHERE text_match(log, 'fog AND whales')", [("v11",)]),
    ("SELECT _id FROM voyages WHERE text_match(log, \"wind -light\")", [("v09",)]),
    ("SELECT _id FROM voyages WHERE text_match(log, '\"slow finish\"')", [("v12",)]),
    ("SELECT count(*) AS n FROM voyages WHERE text_match(log, '\"finish slow\"')", [(0,)]),
    ("SELECT _id FROM voyages WHERE text_match(log, 'harbour') AND text_match(log, 'slow')", [("v03",)]),
    ("SELECT count(*) AS n FROM voyages WHERE log = 'fog'", [(2,)]),
    ("SELECT count(*) AS n FROM voyages WHERE log = 'Fog'", [(0,)]),
    ("SELECT ROUND(SUM(miles) / SUM(hours), 2) AS knots FROM voyages", [(5.7,)]),
    ("SELECT ROUND(AVG(miles / hours), 1) AS knots FROM voyages", [(4.7,)]),
    ("SELECT ROUND(hours / 2.0) AS up, ROUND(-hours / 2.0) AS down FROM voyages WHERE _id = 'v06'", [(3.0, -3.0)]),
    ("SELECT skipper, max(hours) - min(hours) AS spread FROM voyages GROUP BY skipper HAVING spread > 30 ORDER BY skipper", [("jonas", 34), ("mara", 47)]),
    ("SELECT harbour, sum(miles) AS m FROM voyages GROUP BY harbour HAVING m > 190 AND 2 < count(*) ORDER BY m DESC", [("brest", 558), ("kiel", 306)]),
    ("SELECT skipper FROM voyages ORDER BY miles LIMIT 1, 2", [("mara",), ("jonas",)]),
    ("SELECT DISTINCT harbour FROM voyages ORDER BY harbour DESC LIMIT 2", [("sagres",), ("lagos",)]),
    ("SELECT miles FROM voyages WHERE skipper IN ('pia', 'quinn') ORDER BY miles DESC", [(96,), (55,), (29,)]),
    ("SELECT count(*) AS n FROM voyages WHERE harbour IN (SELECT harbour FROM voyages WHERE text_match(log, 'whales'))", [(6,)]),
    ("SELECT _id FROM voyages WHERE skipper IN (SELECT skipper FROM voyages GROUP BY skipper HAVING count(*) > 2) ORDER BY miles LIMIT 1", [("v06",)]),
    ("SELECT hours / 0 AS z FROM voyages LIMIT 1", [(None,)]),
    ("SELECT nullif(harbour, 'brest') AS h, count(*) AS n FROM voyages GROUP BY 1 ORDER BY h DESC LIMIT 2", [(None, 4), ("sagres", 2)]),
    ("SELECT nullif(harbour, 'brest') AS h FROM voyages ORDER BY h LIMIT 1", [("kiel",)]),
    ("SELECT SKIPPER AS who FROM voyages WHERE Miles = 310", [("mara",)]),
    ("SELECT count(*) AS n FROM voyages WHERE NOT text_match(log, 'storm') OR hours > 30", [(10,)]),
    ("SELECT count(*) AS n FROM voyages WHERE harbour IS DISTINCT FROM 'kiel'", [(9,)]),
    ("SELECT count(*) AS n FROM voyages WHERE miles BETWEEN 29 AND 96 AND 12 <= hours", [(3,)]),
    ("SELECT count(*) AS n, min(hours) AS h FROM voyages WHERE miles > 5000", [(0, None)]),
]

#: The same meaning wherever a SELECT stands: text fields by token, nulls greatest, rounding half away from zero.
NESTED = [
    ("WITH f AS (SELECT _id, log FROM voyages WHERE log = 'fog') SELECT _id FROM f ORDER BY _id", [("v03",), ("v11",)]),
    ("WITH f AS (SELECT * FROM voyages) SELECT _id FROM f WHERE log = 'fog' ORDER BY _id", [("v03",), ("v11",)]),
    ("WITH f AS (SELECT nullif(harbour, 'kiel') AS h FROM voyages) SELECT DISTINCT h FROM f ORDER BY h DESC LIMIT 2", [(None,), ("sagres",)]),
    ("WITH a AS (SELECT hours FROM voyages WHERE miles = 8), b AS (SELECT ROUND(hours / 2.0) AS r, hours / 0 AS z FROM a) SELECT * FROM b", [(3.0, None)]),
    ("SELECT _id FROM (SELECT _id, log FROM voyages WHERE log = 'storm') t WHERE _id > 'v03' ORDER BY _id", [("v04",), ("v08",)]),
    ("SELECT count(*) AS n FROM (SELECT * FROM voyages) AS t WHERE t.log = 'storm'", [(3,)]),
    ("SELECT _id FROM voyages WHERE log = 'cape' UNION ALL SELECT _id FROM voyages WHERE log = 'wind' AND text_match(log, 'light') ORDER BY _id", [("v02",), ("v05",), ("v10",)]),
    ("SELECT nullif(skipper, 'ines') AS s FROM voyages UNION SELECT harbour FROM voyages WHERE miles = 3 ORDER BY s LIMIT 1", [("brest",)]),
    ("SELECT nullif(skipper, 'ines') AS s FROM voyages UNION SELECT harbour FROM voyages WHERE miles = 3 ORDER BY s DESC LIMIT 1", [(None,)]),
    ("SELECT log FROM voyages WHERE log = 'fog' EXCEPT SELECT log FROM voyages WHERE log = 'whales'", [("Fog at the harbour mouth, slow going",)]),
    ("SELECT a._id AS x, b._id AS y FROM voyages a JOIN voyages b ON a.harbour = b.harbour AND a._id < b._id WHERE a.log = 'fog' AND b.log = 'wind' ORDER BY x, y", [("v03", "v10")]),
    ("SELECT a._id AS x FROM voyages a LEFT JOIN voyages b ON b.skipper = a.skipper AND b.miles > 100 WHERE a.log = 'slow' AND b._id IS NULL ORDER BY x", [("v12",)]),
    ("SELECT v._id FROM voyages v WHERE EXISTS (SELECT 1 FROM voyages w WHERE w.skipper = v.skipper AND w.log = 'whales' AND w._id <> v._id) ORDER BY v._id", [("v06",), ("v07",), ("v10",)]),
    ("SELECT _id FROM voyages WHERE log = 'harbour' AND miles < (SELECT avg(miles) FROM voyages WHERE log = 'storm') ORDER BY _id LIMIT 2", [("v03",), ("v06",)]),
]


@pytest.mark.parametrize(("text", "rows"), NESTED, ids=[str(i) for i in range(len(NESTED))])
def test_one_meaning_in_every_block(voyages, text, rows):
    assert [tuple(r) for r in voyages.sql(text).collect()] == rows


@pytest.mark.parametrize(("text", "rows"), CASES, ids=[str(i) for i in range(len(CASES))])
def test_values(voyages, text, rows):
    assert [tuple(r) for r in voyages.sql(text).collect()] == rows


def test_score_orders_shorter_texts_first(voyages):
    rows = voyages.sql("SELECT _id, _score FROM voyages WHERE text_match(log, 'storm') ORDER BY _score DESC, _id").collect()
    assert [r["_id"] for r in rows] == ["v08", "v02", "v04"]
    assert all(a["_score"] >= b["_score"] > 0 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize(
    "text",
    [
        "WITH w AS (SELECT * FROM voyages) SELECT * FROM w",
        "SELECT a._id FROM voyages a JOIN voyages b ON a.miles = b.hours",
        "SELECT skipper FROM voyages INTERSECT SELECT harbour FROM voyages",
        "SELECT log FROM voyages, voyages",
        "SELECT miles, (SELECT min(hours) FROM voyages) AS h FROM voyages",
        "SELECT log FROM voyages WHERE harbour NOT IN (SELECT harbour FROM voyages)",
        "SELECT log FROM voyages WHERE EXISTS (SELECT 1 FROM voyages)",
        "SELECT log FROM voyages WHERE hours * 2 IN (SELECT miles FROM voyages)",
        "SELECT log FROM voyages WHERE text_match(log, 'moon') OR hours < 3",
        "SELECT rank() OVER (ORDER BY miles) AS r FROM voyages",
    ],
)
def test_strict_refuses(voyages, text):
    with pytest.raises(ParsingError):
        voyages.sql(text, strict=True)


def test_strict_allows_one_semijoin(voyages):
    text = "SELECT _id FROM voyages WHERE harbour IN (SELECT harbour FROM voyages WHERE hours > 45) AND text_match(log, 'wind')"
    assert [r["_id"] for r in voyages.sql(text, strict=True).collect()] == ["v09"]


def test_errors(spark, voyages):
    with pytest.raises(IndexNotFound):
        voyages.sql("SELECT 1 AS x FROM ports")
    with pytest.raises(SqlFailed):
        voyages.sql("SELECT tonnage FROM voyages")
    with pytest.raises(SqlFailed):  # an output name means nothing in WHERE
        voyages.sql("SELECT miles / hours AS knots FROM voyages WHERE knots > 8")
    with pytest.raises(ParsingError):
        voyages.sql("SELECT text_match(log) FROM voyages")
    with pytest.raises(ParsingError):
        voyages.sql("SELECT 2; SELECT 3")
    with pytest.raises(GroupByText):
        voyages.sql("SELECT log, max(miles) AS m FROM voyages GROUP BY log", strict=True)
    with pytest.raises(ParsingError):
        voyages.sql("SELECT harbour AS h, sum(miles) AS h FROM voyages GROUP BY harbour")


def test_names(spark):
    from findling import Catalog

    catalog = Catalog(spark)
    catalog.register("tide-tables", spark.createDataFrame([("1", 7, 2.25), ("2", 7, 0.5)], "_id string, GaugeNo long, heightM double"))
    assert catalog.sql('SELECT gaugeno, sum(HEIGHTM) AS m FROM "tide-tables" GROUP BY GaugeNo').first()["m"] == 2.75
    assert catalog.sql("SELECT count(*) AS n FROM tide-tables").first()["n"] == 2
    catalog.indices["tide-tables"].mapping.fields["gaugeNo"] = "integer"
    with pytest.raises(AmbiguousColumn):
        catalog.sql('SELECT GAUGENO FROM "tide-tables"')


def test_metadata_and_explain(voyages):
    assert [tuple(r) for r in voyages.sql("DESCRIBE voyages").collect()][0] == ("harbour", "keyword")
    assert voyages.sql("SHOW TABLES").first()["docs"] == 12
    assert "log" in json.loads(voyages.sql("SHOW CREATE TABLE voyages").first()["create_body"])["mappings"]["properties"]
    facts = voyages.explain("SELECT harbour, count(*) AS n FROM voyages WHERE text_match(log, 'slow') AND hours > 8 AND log LIKE '%s%' GROUP BY harbour", analyze=True)
    assert facts["text_matches"] == [{"field": "log", "query": "slow"}]
    assert facts["pushed_down_filters"] == ["hours > 8"] and facts["has_residual_predicates"] and facts["group_by_columns"] == ["harbour"]
    assert facts["execution_mode"] == "grouped" and facts["pushdown_summary"] == {"text_matches": 1, "filters": 1, "residual": 1}
    assert voyages.explain("SELECT count(*) AS n FROM voyages WHERE hours > 8")["execution_mode"] == "count"
    assert facts["rows"] == 1 and "HashAggregate" in facts["physical_plan"]


def test_stream(voyages):
    frames = [json.loads(x) for x in voyages.stream("SELECT skipper FROM voyages WHERE miles > 150 ORDER BY skipper")]
    assert frames[0]["meta"]["columns"] == ["skipper"] and [f["row"]["skipper"] for f in frames[1:]] == ["jonas", "mara", "otto"]
