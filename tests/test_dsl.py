"""Clauses, sorting, cursors, aggregations, vectors; and the DSL against a plain evaluator."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from findling.errors import IllegalArgument, ParsingError
from findling.functions.query_string import analyse
from findling.operators import translate

from .conftest import VOYAGES


def ids(result):
    return [r["_id"] for r in result.hits.collect()]


def found(voyages, query):
    return sorted(ids(voyages.index("voyages").search({"query": query, "size": 100})))


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ({"match": {"log": "fog moon"}}, ["v03", "v07", "v11"]),
        ({"match": {}}, [v[0] for v in VOYAGES]),
        ({"term": {"log": "harbour"}}, ["v03", "v06", "v08"]),
        ({"term": {"log": "Harbour"}}, []),
        ({"term": {"skipper": "quinn"}}, ["v12"]),
        ({"term": {"hours": "21"}}, ["v02"]),
        ({"range": {"miles": {"gt": 96, "gte": 1, "lt": 260}}}, ["v02", "v09"]),
        ({"prefix": {"log": "light"}}, ["v10"]),
        ({"prefix": {"log": "s"}}, ["v01", "v02", "v03", "v04", "v05", "v08", "v11", "v12"]),
        ({"wildcard": {"log": "w?nd"}}, ["v09", "v10"]),
        ({"wildcard": {"harbour": "*gos"}}, ["v01", "v06", "v12"]),
        ({"fuzzy": {"log": {"value": "sotrm"}}}, ["v02", "v04", "v08"]),
        ({"fuzzy": {"log": {"value": "whale", "fuzziness": 1}}}, ["v05", "v11"]),
        ({"fuzzy": {"log": {"value": "fgo", "fuzziness": 0}}}, []),
        ({"fuzzy": {"log": {"value": "harobur", "fuzziness": 2}}}, ["v03", "v06", "v08"]),
        ({"bool": {"should": [{"term": {"skipper": "quinn"}}, {"term": {"harbour": "sagres"}}]}}, ["v02", "v05", "v12"]),
        ({"bool": {"must": [{"match": {"log": "storm"}}], "must_not": [{"term": {"harbour": "kiel"}}]}}, ["v02", "v08"]),
        ({"bool": {"must_not": [{"term": {"skipper": "mara"}}]}}, []),
        ({"bool": {}}, [v[0] for v in VOYAGES]),
        ({"match": {"unknown": "otto"}}, ["v08", "v09"]),
    ],
)
def test_clauses(voyages, query, expected):
    assert found(voyages, query) == sorted(expected)


def test_bad_requests(voyages):
    index = voyages.index("voyages")
    for query in ({"nope": {}}, {"bool": {"musst": []}}, {"fuzzy": {"log": {"value": "x", "fuzziness": 3}}}, {"match": {"log": "("}}, {"match": {"log": "fog AND"}}):
        with pytest.raises(ParsingError):
            index.search({"query": query})
    for request in ({"search_after": [1]}, {"sort": ["hours"], "search_after": [1, 2]}, {"sort": ["hours"], "search_after": [1], "from": 2}, {"sort": ["_score"], "search_after": [1]}, {"sort": ["nothing"]}):
        with pytest.raises(IllegalArgument):
            index.search(request)


def test_paging_with_ties_loses_nothing(spark):
    from findling import Catalog

    rows = [(f"d{i:03d}", i, None if i % 7 == 0 else i // 5) for i in range(60)]
    catalog = Catalog(spark)
    index = catalog.register("ties", spark.createDataFrame(rows, "_id string, n long, tie long"))
    for order in ("asc", "desc"):
        seen, cursor = [], None
        while True:
            request = {"sort": [{"tie": order}, {"_id": "asc"}], "size": 7} | ({"search_after": cursor} if cursor else {})
            page = index.search(request).hits.collect()
            if not page:
                break
            seen += [r["_id"] for r in page]
            cursor = [page[-1]["tie"], page[-1]["_id"]]
        assert sorted(seen) == [r[0] for r in rows] and len(seen) == 60


def test_aggregations(voyages):
    result = voyages.index("voyages").search({"size": 0, "aggs": {"by": {"terms": {"field": "harbour", "size": 2}}, "s": {"stats": {"field": "miles"}}, "h": {"histogram": {"field": "hours", "interval": 20}}, "none": {"sum": {"field": "missing"}}}})
    assert result.hits.count() == 0 and result.total() == 12
    assert [tuple(r) for r in result.aggs["by"].collect()] == [("brest", 4), ("kiel", 3)]
    assert tuple(result.aggs["s"].first()) == (12, 3.0, 310.0, 100.25, 1203.0)
    assert [tuple(r) for r in result.aggs["h"].collect()] == [(0.0, 8), (20.0, 2), (40.0, 2)]
    assert result.aggs["none"].first()["value"] == 0.0


def test_vectors_and_fusion(spark):
    from findling import Catalog

    rows = [("a", "red fox", [1.0, 0.0]), ("b", "red dog", [0.0, 1.0]), ("c", "blue dog", [0.7, 0.7]), ("d", None, None), ("e", "fox", [1.0, 0.0, 0.0])]
    index = Catalog(spark).register("v", spark.createDataFrame(rows, "_id string, t string, e array<float>"), ("t",))
    near = index.search({"knn": {"e": {"vector": [1, 0.1], "k": 3}}}).hits.collect()
    assert [r["_id"] for r in near] == ["a", "c", "b"] and near[0]["_score"] == pytest.approx(1 / (1 + near[0]["_knn_distance"]))
    assert [r["_id"] for r in index.search({"knn": {"e": {"vector": [1, 0.1], "k": 3, "filter": {"term": {"t": "dog"}}}}}).hits.collect()] == ["c", "b"]
    fused = index.search({"query": {"match": {"t": "dog"}}, "knn": {"e": {"vector": [0, 1], "k": 1}}}).hits.collect()
    assert fused[0]["_id"] == "b" and fused[0]["_score"] == pytest.approx(2 / 61)


def test_fuzzy_against_definition(spark):
    """Unrestricted edit distance with transpositions, up to two, on words of a small alphabet."""
    import duckdb

    from findling.functions import fuzzy_sql

    words = sorted({"".join(w) for n in range(1, 5) for w in __import__("itertools").product("abc", repeat=n)})
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    frame = frame.coalesce(1)
    for target in ("abca", "ab", "a", "acb"):
        for k in (1, 2):
            got = {r["w"] for r in frame.where(fuzzy_sql("w", target, k)).collect()}
            expected = {w for w in words if duckdb.execute("select damerau_levenshtein(?, ?)", [w, target]).fetchall()[0][0] <= k}
            assert got == expected, (target, k, got ^ expected)


WORDS = ["storm", "harbour", "slow", "wind", "whales"]
LEAF = st.one_of(
    st.sampled_from(WORDS).map(lambda w: {"term": {"log": w}}),
    st.sampled_from(["mara", "otto", "pia"]).map(lambda w: {"term": {"skipper": w}}),
    st.integers(0, 320).map(lambda n: {"range": {"miles": {"gte": n}}}),
    st.sampled_from(WORDS).map(lambda w: {"prefix": {"log": w[:3]}}),
)
QUERY = st.recursive(
    LEAF,
    lambda q: st.fixed_dictionaries({}, optional={k: st.lists(q, max_size=2) for k in ("must", "filter", "should", "must_not")}).map(lambda b: {"bool": b}),
    max_leaves=6,
)


def holds(query, row):
    kind, body = next(iter(query.items()))
    _, log, skipper, miles, _, _ = row
    tokens = re.findall(r"[a-z0-9]+", log.lower())
    if kind == "bool":
        required = body.get("must", []) + body.get("filter", [])
        should, never = body.get("should", []), body.get("must_not", [])
        if not required and not should:
            return not never
        return all(holds(q, row) for q in required) and (bool(required) or any(holds(q, row) for q in should)) and not any(holds(q, row) for q in never)
    name, value = next(iter(body.items()))
    if kind == "range":
        return miles >= value["gte"]
    if kind == "prefix":
        return any(t.startswith(value) for t in tokens)
    return value in tokens if name == "log" else skipper == value


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(QUERY)
def test_random_queries(voyages, query):
    index = voyages.index("voyages")
    got = {r["_id"] for r in index.frame().where(translate(query, index.mapping).column()).select("_id").collect()}
    assert got == {r[0] for r in VOYAGES if holds(query, r)}


def test_analyse():
    assert analyse("Buoy Nº-7, Häfen " + "y" * 41) == ["buoy", "nº", "7", "häfen"]
