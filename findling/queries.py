"""Named queries over the driver's tables, each with the SQL that must give the same rows.

Every query goes through the public surface: the JSON DSL, the SQL front end, or the operators.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import null_last, round_half_away, safe_divide
from .operators import aggregate, bm25, knn, rrf, search, translate
from .operators import count as count_matches
from .operators.search import after
from .sources import Catalog, Index, TermFiles, latest
from .sources.index import overlay
from .streaming import dedup_within, session_counts, tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]

#: Tables with their key and analysed columns.
TABLES = {
    "region": ("r_regionkey", ()),
    "nation": ("n_nationkey", ()),
    "customer": ("c_custkey", ()),
    "supplier": ("s_suppkey", ()),
    "part": ("p_partkey", ("p_name",)),
    "orders": ("o_orderkey", ()),
    "lineitem": (None, ()),
    "events": ("event_id", ()),
    "documents": ("doc_id", ("text",)),
    "embeddings": ("vec_id", ()),
    "pages": ("page_id", ("html",)),
    "conversations": (None, ("text",)),
    "benchmark": ("item_id", ("text",)),
    "labels": ("doc_id", ()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps as instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    instants = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in instants}) if instants else df


def index(spark: SparkSession, sf_dir: str, name: str) -> Index:
    return catalog(spark, sf_dir, name).index(name)


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    out = Catalog(spark)
    for name in names:
        key, text = TABLES[name]
        out.register(name, table(spark, sf_dir, name), text, key)
    return out


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The analyser in the oracle's SQL.
TOK = r"list_filter(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)', 1), lambda t: strlen(t) <= 40)"


def toks(column: str) -> str:
    return TOK.format(column)


def add(name: str, oracle: str | None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLE[name] = oracle
        return query

    return keep


def sql(name: str, tables: str | tuple[str, ...], text: str, oracle: str | None = None) -> None:
    """A query in the engine's SQL; the oracle is the same text unless it differs in dialect."""
    names = (tables,) if isinstance(tables, str) else tables

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return catalog(spark, sf_dir, *names).sql(text)

    QUERIES[name], ORACLE[name] = query, oracle or text


def dsl(name: str, of: str, query: dict, columns: list[str], where: str) -> None:
    """All rows that a DSL query matches."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = index(spark, sf_dir, of)
        return found.frame().where(translate(query, found.mapping).column()).select(*columns)

    QUERIES[name], ORACLE[name] = run, f"SELECT {', '.join(columns)} FROM {of} WHERE {where}"


# Full text

TEXT_GROUP = "SELECT lang, count(*) AS n, avg(n_chars) AS a FROM documents WHERE text_match(text, 'the OR un') GROUP BY lang HAVING n > 1 ORDER BY a DESC LIMIT 10"
sql("text_group_having_topk", "documents", TEXT_GROUP, f"SELECT lang, count(*) AS n, avg(n_chars) AS a FROM documents WHERE list_has_any({toks('text')}, ['the', 'un']) GROUP BY lang HAVING count(*) > 1 ORDER BY a DESC LIMIT 10")
sql("text_match_count", "documents", "SELECT count(*) AS n FROM documents WHERE text_match(text, 'the')", f"SELECT count(*) AS n FROM documents WHERE list_contains({toks('text')}, 'the')")
sql("text_match_or_terms", "documents", "SELECT doc_id, source FROM documents WHERE text_match(text, 'anthat erst')", f"SELECT doc_id, source FROM documents WHERE list_has_any({toks('text')}, ['anthat', 'erst'])")
sql("text_match_multi_and", "documents", "SELECT doc_id FROM documents WHERE text_match(text, 'with') AND text_match(text, 'from') AND lang = 'en'", f"SELECT doc_id FROM documents WHERE list_has_all({toks('text')}, ['with', 'from']) AND lang = 'en'")
sql("text_match_grammar", "documents", "SELECT doc_id FROM documents WHERE text_match(text, '(le AND des) OR +der -und')", f"SELECT doc_id FROM (SELECT doc_id, {toks('text')} AS t FROM documents) WHERE list_contains(t, 'der') AND NOT list_contains(t, 'und')")
sql("text_match_phrase", "documents", "SELECT doc_id FROM documents WHERE text_match(text, '\"of the\"')", f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({toks('text')}, ' ') || ' ', ' of the ')")
sql("text_match_in_case", "documents", "SELECT CASE WHEN text_match(text, 'the') THEN 'yes' ELSE 'no' END AS has_the, count(*) AS n FROM documents GROUP BY 1", f"SELECT CASE WHEN list_contains({toks('text')}, 'the') THEN 'yes' ELSE 'no' END AS has_the, count(*) AS n FROM documents GROUP BY 1")
dsl("match_all", "nation", {"match_all": {}}, ["n_nationkey", "n_name"], "true")
dsl("match_none", "nation", {"match_none": {}}, ["n_nationkey", "n_name"], "false")
dsl("match_dsl", "conversations", {"match": {"text": "the was"}}, ["conv_id", "turn"], f"list_has_any({toks('text')}, ['the', 'was'])")
dsl("match_keyword_field", "customer", {"match": {"c_mktsegment": "BUILDING"}}, ["c_custkey"], "c_mktsegment = 'BUILDING'")
dsl("match_body", "documents", {"match": {"body": "src3"}}, ["doc_id"], f"list_contains({toks('concat_ws(chr(32), doc_id, text, lang, source, n_chars)')}, 'src3')")
dsl("term_keyword", "events", {"term": {"event_type": "click"}}, ["event_id", "user_id"], "event_type = 'click'")
dsl("term_number_as_text", "orders", {"term": {"o_custkey": "37"}}, ["o_orderkey"], "o_custkey = 37")
dsl("term_text_token", "documents", {"term": {"text": "the"}}, ["doc_id"], f"list_contains({toks('text')}, 'the')")
dsl("term_text_not_analysed", "documents", {"term": {"text": "The"}}, ["doc_id"], "false")
dsl("range_num", "orders", {"range": {"o_totalprice": {"gte": 1000, "lt": 50000}}}, ["o_orderkey", "o_totalprice"], "o_totalprice >= 1000 AND o_totalprice < 50000")
dsl("range_date", "orders", {"range": {"o_orderdate": {"gt": "1995-03-01", "lte": "1996-01-01T00:00:00Z"}}}, ["o_orderkey"], "o_orderdate > TIMESTAMP '1995-03-01' AND o_orderdate <= TIMESTAMP '1996-01-01'")
dsl("range_gt_wins", "part", {"range": {"p_size": {"gt": 10, "gte": 5, "lt": 20, "lte": 40}}}, ["p_partkey"], "p_size > 10 AND p_size < 20")
dsl("range_text_tokens", "part", {"range": {"p_name": {"gte": "b", "lt": "c"}}}, ["p_partkey"], f"len(list_filter({toks('p_name')}, lambda t: t >= 'b' AND t < 'c')) > 0")
dsl("prefix_token", "documents", {"prefix": {"text": "ther"}}, ["doc_id"], f"len(list_filter({toks('text')}, lambda t: starts_with(t, 'ther'))) > 0")
dsl("prefix_keyword", "customer", {"prefix": {"c_name": "Customer#00000001"}}, ["c_custkey"], "starts_with(c_name, 'Customer#00000001')")
dsl("wildcard_token", "documents", {"wildcard": {"text": "an*th?t"}}, ["doc_id"], f"len(list_filter({toks('text')}, lambda t: t LIKE 'an%th_t')) > 0")
dsl("wildcard_keyword", "part", {"wildcard": {"p_brand": "Brand#1?"}}, ["p_partkey"], "p_brand LIKE 'Brand#1_'")
dsl("fuzzy_token", "documents", {"bool": {"must": [{"fuzzy": {"text": {"value": "teh", "fuzziness": 1}}}], "filter": [{"term": {"lang": "en"}}]}}, ["doc_id"], f"lang = 'en' AND len(list_filter({toks('text')}, lambda t: damerau_levenshtein(t, 'teh') <= 1)) > 0")
dsl("fuzzy_token_two", "part", {"fuzzy": {"p_name": {"value": "gren", "fuzziness": 2}}}, ["p_partkey"], f"len(list_filter({toks('p_name')}, lambda t: damerau_levenshtein(t, 'gren') <= 2)) > 0")
dsl("bool_nested", "lineitem", {"bool": {"must": [{"term": {"l_returnflag": "R"}}], "filter": [{"bool": {"should": [{"range": {"l_quantity": {"lt": 10}}}, {"range": {"l_discount": {"gte": 0.09}}}]}}], "must_not": [{"term": {"l_linestatus": "F"}}]}}, ["l_orderkey", "l_linenumber", "l_quantity"], "l_returnflag = 'R' AND (l_quantity < 10 OR l_discount >= 0.09) AND NOT l_linestatus = 'F'")
dsl("bool_should_only", "events", {"bool": {"should": [{"term": {"event_type": "click"}}, {"range": {"value": {"gt": 90}}}]}}, ["event_id"], "event_type = 'click' OR value > 90")
dsl("bool_should_optional", "events", {"bool": {"must": [{"term": {"event_type": "click"}}], "should": [{"range": {"value": {"gt": 90}}}]}}, ["event_id"], "event_type = 'click'")
dsl("bool_must_not", "documents", {"bool": {"must": [{"match_all": {}}], "must_not": [{"term": {"lang": "en"}}]}}, ["doc_id", "lang"], "lang <> 'en'")
dsl("bool_pure_negative", "documents", {"bool": {"must_not": [{"term": {"lang": "en"}}]}}, ["doc_id", "lang"], "false")
dsl("bool_empty", "region", {"bool": {}}, ["r_regionkey"], "true")


@add("must_not_keeps_null", "SELECT event_id FROM events WHERE event_type = 'click' OR NOT value > 50")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "events")
    rows = found.frame().withColumn("value", F.when(F.col("event_type") != "click", F.col("value")))
    return rows.where(translate({"bool": {"must": [{"match_all": {}}], "must_not": [{"range": {"value": {"gt": 50}}}]}}, found.mapping).column()).select("event_id")


@add("count_query", "SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "orders")
    return count_matches(found.frame(), {"query": {"term": {"o_orderstatus": "F"}}}, found.mapping)


# Scores

BM25_ORACLE = f"""
WITH d AS (SELECT doc_id, {toks('text')} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS l, sum(CAST(list_contains(t, 'with') AS INT)) AS d1, sum(CAST(list_contains(t, 'from') AS INT)) AS d2 FROM d),
x AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda y: y = 'with')) AS f1, len(list_filter(t, lambda y: y = 'from')) AS f2 FROM d),
r AS (SELECT doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / l)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / l)) AS score FROM x, s WHERE f1 > 0 OR f2 > 0)
"""


@add("bm25_topk", BM25_ORACLE + "SELECT doc_id, round(score, 6) AS score FROM r ORDER BY score DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "documents")
    hits = search(found.frame(), {"query": {"match": {"text": "with from"}}, "size": 20}, found.mapping).hits
    return hits.select("doc_id", F.round("_score", 6).alias("score"))


sql("sql_score", "documents", "SELECT doc_id, round(_score, 4) AS s FROM documents WHERE text_match(text, 'with from') AND _score > 1.0", BM25_ORACLE + "SELECT doc_id, round(score, 4) AS s FROM r WHERE score > 1.0")


@add("max_score", BM25_ORACLE + "SELECT round(max(score), 6) AS m FROM r")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "documents")
    return bm25(found.frame(), translate({"match": {"text": "with from"}}, found.mapping), found.mapping).agg(F.round(F.max("_score"), 6).alias("m"))


# Vectors

QUERY_VECTOR = [round(((i * 37) % 64) / 32 - 1, 5) for i in range(64)]
_VECTOR = "[" + ", ".join(map(str, QUERY_VECTOR)) + "]"
_COSINE = f"1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[]))"


def near(spark, sf_dir, where=None, metric="cosine", k=10):
    return knn(index(spark, sf_dir, "embeddings").frame(), "embedding", QUERY_VECTOR, k, where, metric)


@add("knn_cosine", f"SELECT vec_id, round({_COSINE}, 6) AS dist, round(1 / (1 + {_COSINE}), 6) AS score FROM embeddings ORDER BY {_COSINE}, CAST(vec_id AS VARCHAR) LIMIT 10")
def _(spark, sf_dir):
    return near(spark, sf_dir).select("vec_id", F.round("_knn_distance", 6).alias("dist"), F.round("_score", 6).alias("score"))


@add("knn_filtered", f"SELECT vec_id, label, round({_COSINE}, 6) AS dist FROM embeddings WHERE label = 3 ORDER BY {_COSINE}, CAST(vec_id AS VARCHAR) LIMIT 5")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "embeddings")
    hits = search(found.frame(), {"knn": {"embedding": {"vector": QUERY_VECTOR, "k": 5, "filter": {"term": {"label": 3}}}}}, found.mapping).hits
    return hits.select("vec_id", "label", F.round("_knn_distance", 6).alias("dist"))


@add("knn_l2", f"SELECT vec_id, round(pow(list_distance(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[])), 2), 6) AS dist FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[])), CAST(vec_id AS VARCHAR) LIMIT 7")
def _(spark, sf_dir):
    return near(spark, sf_dir, metric="l2", k=7).select("vec_id", F.round("_knn_distance", 6).alias("dist"))


@add(
    "rrf_hybrid",
    BM25_ORACLE
    + f""", a AS (SELECT CAST(doc_id AS VARCHAR) AS id, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS x FROM r QUALIFY x <= 30),
b AS (SELECT CAST(vec_id AS VARCHAR) AS id, row_number() OVER (ORDER BY {_COSINE}, CAST(vec_id AS VARCHAR)) AS y FROM embeddings QUALIFY y <= 30)
SELECT coalesce(a.id, b.id) AS id, round(coalesce(1 / (60 + x), 0) + coalesce(1 / (60 + y), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id""",
)
def _(spark, sf_dir):
    found = index(spark, sf_dir, "documents")
    text = search(found.frame(), {"query": {"match": {"text": "with from"}}, "size": 30}, found.mapping).hits
    return rrf(text, near(spark, sf_dir, k=30)).select(F.col("_id").alias("id"), F.round("_score", 9).alias("score"))


# Projection, predicates

sql("select_star", "region", "SELECT * FROM region", "SELECT *, CAST(r_regionkey AS VARCHAR) AS _id FROM region")
sql("project_alias", "nation", "SELECT n_name AS country, n_regionkey FROM nation")
sql("distinct", "customer", "SELECT DISTINCT c_mktsegment FROM customer")
sql("scalar_functions", "part", "SELECT p_partkey, upper(p_brand) AS b, CAST(length(p_type) AS INT) AS n, p_retailprice * 2 AS dbl, concat(p_name, '!') AS s, substring(p_type, 1, 3) AS pre FROM part WHERE p_size < 10")
sql("literal_projection", "region", "SELECT 1 AS one, 'x' AS x FROM region")
sql("in_list", "orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 40)")
sql("between", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000")
sql("or_push", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_totalprice > 300000 AND o_orderstatus = 'F')")
sql("flipped_literal", "orders", "SELECT o_orderkey FROM orders WHERE 250000 < o_totalprice AND 'F' = o_orderstatus")
sql("negative_literal", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal < -500 AND c_acctbal >= -900.5")
sql("not_in", "orders", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
sql("not_between", "part", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
sql("not_equal", "nation", "SELECT n_name FROM nation WHERE n_regionkey <> 1 AND n_nationkey != 3")
sql("like", "part", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' AND p_type NOT LIKE '%TIN'")
sql("ilike", "part", "SELECT p_partkey FROM part WHERE p_type ILIKE 's%'")
sql("is_null", "orders", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL", None)
sql("is_not_null", "orders", "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT NULL", None)
sql("equals_null", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = NULL", "SELECT o_orderkey FROM orders WHERE false")
sql("column_to_column", "nation", "SELECT n_name FROM nation WHERE n_nationkey > n_regionkey * 5")
sql("date_predicate", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-06-01' AND o_orderdate < '1997-07-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1997-07-01'")
sql("text_equals_token", "part", "SELECT count(*) AS n FROM part WHERE p_name = 'green'", f"SELECT count(*) AS n FROM part WHERE list_contains({toks('p_name')}, 'green')")
sql("case_insensitive_names", "nation", 'SELECT N_NAME AS nm, "n_regionkey" FROM nation WHERE N_RegionKey = 2', "SELECT n_name AS nm, n_regionkey FROM nation WHERE n_regionkey = 2")
sql("id_predicate", "nation", "SELECT n_name FROM nation WHERE _id = '7'", "SELECT n_name FROM nation WHERE n_nationkey = 7")

# Groups

sql("count_star", "lineitem", "SELECT count(*) AS n FROM lineitem")
sql("count_column", "orders", "SELECT count(nullif(o_orderstatus, 'F')) AS n, count(o_custkey) AS m FROM orders")
sql("group_one", "lineitem", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, min(l_tax) AS lo, max(l_tax) AS hi, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag")
sql("group_two", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY n DESC")
sql("group_multi", "lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem WHERE l_quantity > 5 GROUP BY l_returnflag, l_linestatus, l_linenumber")
sql("group_expr", "part", "SELECT floor(p_size / 10) AS decade, count(*) AS n FROM part GROUP BY floor(p_size / 10)", "SELECT CAST(floor(p_size / 10) AS BIGINT) AS decade, count(*) AS n FROM part GROUP BY floor(p_size / 10)")
sql("group_alias_ordinal", "part", "SELECT lower(p_brand) AS b, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, b LIMIT 5")
sql("group_null_key", "orders", "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS n FROM orders GROUP BY 1")
sql("group_case_bucket", "nation", "SELECT CASE WHEN n_name < 'F' THEN 'a-e' WHEN n_name < 'K' THEN 'f-j' ELSE 'rest' END AS bucket, count(*) AS n FROM nation GROUP BY CASE WHEN n_name < 'F' THEN 'a-e' WHEN n_name < 'K' THEN 'f-j' ELSE 'rest' END")
sql("agg_row_expr", "lineitem", "SELECT l_returnflag, round(avg((l_extendedprice - l_discount) / (l_quantity - 10)), 6) AS r FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(avg((l_extendedprice - l_discount) / nullif(l_quantity - 10, 0)), 6) AS r FROM lineitem GROUP BY l_returnflag")
sql("agg_residual_round", "orders", "SELECT o_orderpriority, ROUND(avg(o_totalprice) / 1000, 1) AS k FROM orders GROUP BY o_orderpriority")
sql("agg_residual_ratio", "lineitem", "SELECT l_linestatus, round(sum(l_discount) / sum(l_quantity) * 100 - min(l_tax), 8) AS r, max(l_linenumber) - min(l_linenumber) AS spread FROM lineitem GROUP BY l_linestatus")
sql("agg_divide_by_zero", "orders", "SELECT sum(o_totalprice) / (count(*) - count(*)) AS z FROM orders", "SELECT CAST(NULL AS DOUBLE) AS z")
sql("agg_cast_int", "orders", "SELECT o_orderstatus, CAST(avg(o_totalprice) AS INT) AS a FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(trunc(avg(o_totalprice)) AS INT) AS a FROM orders GROUP BY o_orderstatus")
sql("agg_zero_match", "events", "SELECT count(*) AS n, sum(value) AS s, min(value) AS lo FROM events WHERE event_type = 'no-such-type'")
sql("having_flipped_and", "events", "SELECT user_id, count(*) AS n, avg(value) AS a FROM events GROUP BY user_id HAVING 3 <= n AND avg(value) > 50", "SELECT user_id, count(*) AS n, avg(value) AS a FROM events GROUP BY user_id HAVING 3 <= count(*) AND avg(value) > 50")
sql("having_or", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 20 OR max(o_totalprice) > 450000")
sql("order_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql("order_limit_comma", "customer", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 3, 7", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7 OFFSET 3")
sql("order_nulls", "orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC, o_orderkey LIMIT 12", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 12")
sql("order_nulls_asc", "orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey DESC LIMIT 12", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey DESC LIMIT 12")
sql("count_distinct", "events", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
sql("rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")

# Joins, subqueries, sets, windows

sql("semijoin_grouped_inner", "orders", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1) GROUP BY o_orderpriority")
sql("semijoin_empty", "orders", "SELECT count(*) AS n, max(o_totalprice) AS hi FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)")
sql("semijoin_ordered_inner", "orders", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)")
sql("join_inner", ("nation", "region"), "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
sql("join_left", ("customer", "orders"), "SELECT c_mktsegment, count(*) AS n, count(o_orderkey) AS m FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_mktsegment")
sql("anti_join", ("customer", "orders"), "SELECT count(*) AS n FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT count(*) AS n FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql("scalar_subquery", "orders", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
sql("union_all", ("nation", "region"), "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
sql("except_set", "customer", "SELECT c_nationkey FROM customer EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
sql("cte", "orders", "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) SELECT count(*) AS n FROM big")
sql("window_rank", "customer", "SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS r FROM customer")
sql("window_frame", "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s FROM events")

# DSL aggregations


def agg(name: str, of: str, body: dict, oracle: str, query: dict | None = None, shape: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = index(spark, sf_dir, of)
        rows = found.frame().where(translate(query, found.mapping).column())
        return shape(aggregate(rows, {"a": body}, found.mapping)["a"])

    QUERIES[name], ORACLE[name] = run, oracle


agg("terms_agg", "orders", {"terms": {"field": "o_orderpriority", "size": 3}}, "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
agg("terms_agg_filtered", "events", {"terms": {"field": "user_id"}}, "SELECT user_id AS key, count(*) AS doc_count FROM events WHERE event_type = 'click' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", {"term": {"event_type": "click"}})
agg("stats_agg", "orders", {"stats": {"field": "o_totalprice"}}, "SELECT count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS avg, round(sum(o_totalprice), 2) AS sum FROM orders", None, lambda d: d.select("count", "min", "max", F.round("avg", 4).alias("avg"), F.round("sum", 2).alias("sum")))
agg("stats_agg_empty", "orders", {"stats": {"field": "o_totalprice"}}, "SELECT CAST(0 AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS avg, 0.0 AS sum", {"match_none": {}})
for _m, _f in (("min", "min(value)"), ("max", "max(value)"), ("sum", "round(sum(value), 4)"), ("avg", "round(avg(value), 6)")):
    agg(f"{_m}_agg", "events", {_m: {"field": "value"}}, f"SELECT {_f} AS value FROM events", None, lambda d, m=_m: d.select(F.round("value", 4 if m == "sum" else 6).alias("value")) if m in ("sum", "avg") else d)
agg("value_count", "events", {"value_count": {"field": "event_type"}}, "SELECT count(event_type) AS value FROM events")
agg("histogram_agg", "orders", {"histogram": {"field": "o_totalprice", "interval": 50000}}, "SELECT floor(o_totalprice / 50000) * 50000 AS key, count(*) AS doc_count FROM orders GROUP BY 1")

# Paging


@add("sort_from_size", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10 OFFSET 20")
def _(spark, sf_dir):
    return index(spark, sf_dir, "orders").search({"query": {"term": {"o_orderstatus": "F"}}, "sort": [{"o_totalprice": "desc"}], "from": 20, "size": 10}).hits.select("o_orderkey", "o_totalprice")


@add("search_after_page2", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-01' OR (o_orderdate = TIMESTAMP '1995-06-01' AND o_totalprice < 150000) ORDER BY o_orderdate, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 15")
def _(spark, sf_dir):
    request = {"sort": [{"o_orderdate": {"order": "asc"}}, {"o_totalprice": "desc"}], "search_after": ["1995-06-01", 150000], "size": 15}
    return index(spark, sf_dir, "orders").search(request).hits.select("o_orderkey", "o_orderdate", "o_totalprice")


@add("search_after_nulls", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > 100 OR o_orderstatus <> 'F' AND o_orderstatus < 'P' ORDER BY o_orderkey LIMIT 40")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "orders")
    rows = found.frame().withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    # Descending: nulls first, then P, then O; the cursor stands at (null, 100).
    cut = after([("o_orderstatus", True), ("o_orderkey", False)], [None, 100], found.mapping)
    return rows.where(cut).where("o_orderstatus is null or o_orderstatus < 'P'").orderBy("o_orderkey").select("o_orderkey").limit(40)


# Documents: versions, updates, deletions, bulk


def versions(spark, sf_dir):
    """Events as versions of their user's document, every seventh a deletion."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("_id"), F.col("event_id").alias("_seq"), (F.col("event_id") % 7 == 0).alias("_deleted"), "event_type", "value")


@add("bulk_upsert_latest", "SELECT CAST(user_id AS VARCHAR) AS _id, event_id AS _seq, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_id % 7 <> 0")
def _(spark, sf_dir):
    return latest(versions(spark, sf_dir))


@add("delete_view", "SELECT count(*) AS n FROM (SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_id % 7 <> 0")
def _(spark, sf_dir):
    return latest(versions(spark, sf_dir)).agg(F.count("*").alias("n"))


@add("partial_update", "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name")).alias("fields"))
    patch = rows.where("c_custkey % 3 = 0").select("_id", F.create_map(F.lit("segment"), F.lit("MOVED"), F.lit("name"), F.lit(None).cast("string")).alias("patch"))
    return overlay(rows.select("_id", "fields"), patch).select("_id", F.col("fields")["segment"].alias("segment"), F.col("fields")["name"].alias("name"))


@add("get_by_id", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 33")
def _(spark, sf_dir):
    return index(spark, sf_dir, "orders").frame().where(F.col("_id") == "33").select("o_orderkey", "o_orderstatus")


@add("describe", "SELECT * FROM (VALUES ('n_name', 'keyword'), ('n_nationkey', 'integer'), ('n_regionkey', 'integer')) t(field, type)")
def _(spark, sf_dir):
    return catalog(spark, sf_dir, "nation").sql("DESCRIBE nation")


@add("show_tables", "SELECT 'nation' AS index, 'table' AS engine, count(*) AS docs, 3 AS fields FROM nation UNION ALL SELECT 'region', 'table', count(*), 2 FROM region")
def _(spark, sf_dir):
    return catalog(spark, sf_dir, "nation", "region").sql("SHOW TABLES")


@add("show_create", """SELECT 'nation' AS index, '{"mappings": {"dynamic": "false", "properties": {"n_name": {"type": "keyword"}, "n_nationkey": {"type": "integer"}, "n_regionkey": {"type": "integer"}}}, "settings": {}}' AS create_body""")
def _(spark, sf_dir):
    return catalog(spark, sf_dir, "nation").sql("SHOW CREATE TABLE nation")


@add("explain", None)
def _(spark, sf_dir):
    facts = catalog(spark, sf_dir, "documents").explain(TEXT_GROUP)
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(facts.items())], "fact string, value string")


# Functions


@add("round_half_away", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS r FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", round_half_away(F.col("o_totalprice") / 7, 2).alias("r"))


@add("safe_divide", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice / nullif(l_quantity - 1, 0) AS r FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", safe_divide(F.col("l_extendedprice"), F.col("l_quantity") - 1).alias("r"))


@add("tokens", f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({toks('text')}) AS t FROM documents) GROUP BY 1")
def _(spark, sf_dir):
    from .functions import tokens

    return table(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@add("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def _(spark, sf_dir):
    k: Column = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"))


# Windows over events


@add("tumbling_window", "SELECT time_bucket(INTERVAL 1 day, ts) AS window_start, time_bucket(INTERVAL 1 day, ts) + INTERVAL 1 day AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 6))


@add("sliding_window", "SELECT w AS window_start, w + INTERVAL 2 day AS window_end, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 day, ts), time_bucket(INTERVAL 1 day, ts) - INTERVAL 1 day]) AS w FROM events) GROUP BY ALL")
def _(spark, sf_dir):
    return tumbling_counts(table(spark, sf_dir, "events"), "ts", "2 days", ["event_type"], "value", "1 day").withColumn("total", F.round("total", 6))


@add("session_window", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 hour AS session_end, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 hour THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def _(spark, sf_dir):
    return session_counts(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])


@add("dedup_keys", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, sf_dir):
    return dedup_within(table(spark, sf_dir, "events"), "ts", ["user_id", "event_type"], "1 day").agg(F.count("*").alias("n"))


@add("rank_order_helper", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, c_custkey) AS r FROM customer")
def _(spark, sf_dir):
    key = F.nullif("c_nationkey", F.lit(3))
    within = Window.partitionBy("c_mktsegment").orderBy(null_last(key, True), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(within).cast("long").alias("r"))


# The same meaning in every SELECT block: text by token, nulls greatest, ROUND half away from zero

_THE = f"list_contains({toks('text')}, 'the')"
sql("cte_text_token", "documents", "WITH d AS (SELECT doc_id, lang, text FROM documents) SELECT lang, count(*) AS n FROM d WHERE text = 'the' GROUP BY lang", f"SELECT lang, count(*) AS n FROM documents WHERE {_THE} GROUP BY lang")
sql("derived_text_token", "documents", "SELECT doc_id FROM (SELECT doc_id, text FROM documents WHERE lang = 'en') t WHERE t.text = 'the'", f"SELECT doc_id FROM documents WHERE lang = 'en' AND {_THE}")
sql("union_text_token", ("documents", "benchmark"), "SELECT doc_id AS id FROM documents WHERE text = 'the' UNION ALL SELECT item_id FROM benchmark WHERE text = 'of'", f"SELECT doc_id AS id FROM documents WHERE {_THE} UNION ALL SELECT item_id FROM benchmark WHERE list_contains({toks('text')}, 'of')")
sql("join_text_token", ("documents", "labels"), "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0 WHERE d.text = 'the' AND d.lang = 'en'", f"SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0 WHERE {_THE} AND d.lang = 'en'")
sql("exists_text_token", ("labels", "documents"), "SELECT l.doc_id FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.text = 'the')", f"SELECT l.doc_id FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND {_THE})")
sql("cte_nulls_round", "orders", "WITH o AS (SELECT nullif(o_orderstatus, 'F') AS s, o_totalprice FROM orders) SELECT s, ROUND(avg(o_totalprice) / 1000, 1) AS p FROM o GROUP BY s ORDER BY s DESC LIMIT 2", "SELECT nullif(o_orderstatus, 'F') AS s, round(avg(o_totalprice) / 1000, 1) AS p FROM orders GROUP BY 1 ORDER BY s DESC NULLS FIRST LIMIT 2")
sql("union_order_nulls", "events", "SELECT nullif(event_type, 'click') AS k, event_id FROM events WHERE event_id < 40 UNION ALL SELECT event_type, event_id FROM events WHERE event_id BETWEEN 100 AND 120 ORDER BY k DESC, event_id LIMIT 12", "SELECT * FROM (SELECT nullif(event_type, 'click') AS k, event_id FROM events WHERE event_id < 40 UNION ALL SELECT event_type, event_id FROM events WHERE event_id BETWEEN 100 AND 120) ORDER BY k DESC NULLS FIRST, event_id LIMIT 12")
sql("window_lag_lead", "orders", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders WHERE o_custkey < 200")
sql("window_order_nulls", "customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 3) DESC, c_custkey) AS r FROM customer", "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY nullif(c_nationkey, 3) DESC NULLS FIRST, c_custkey) AS r FROM customer")
sql("text_match_long_phrase", "documents", "SELECT count(*) AS n FROM documents WHERE text_match(text, '\"that the\"') AND n_chars > 2000", f"SELECT count(*) AS n FROM documents WHERE n_chars > 2000 AND contains(' ' || array_to_string({toks('text')}, ' ') || ' ', ' that the ')")


@add("knn_inner_product", f"SELECT vec_id, round(1 - list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_VECTOR} AS DOUBLE[])), 6) AS dist FROM embeddings ORDER BY dist, CAST(vec_id AS VARCHAR) LIMIT 7")
def _(spark, sf_dir):
    return near(spark, sf_dir, metric="inner_product", k=7).select("vec_id", F.round("_knn_distance", 6).alias("dist"))


@add("hits_with_aggs", "SELECT lang AS key, count(*) AS doc_count, (SELECT count(*) FROM documents WHERE n_chars > 3000) AS total FROM documents WHERE n_chars > 3000 GROUP BY lang")
def _(spark, sf_dir):
    found = index(spark, sf_dir, "documents").search({"query": {"range": {"n_chars": {"gt": 3000}}}, "size": 3, "aggs": {"by": {"terms": {"field": "lang", "size": 100}}}})
    return found.aggs["by"].select("key", "doc_count").withColumn("total", F.lit(found.total()).cast("long"))


@add("search_q", f"SELECT count(*) AS count FROM documents WHERE list_contains({toks('concat_ws(chr(32), doc_id, text, lang, source, n_chars)')}, 'src3')")
def _(spark, sf_dir):
    return spark.range(1).select(F.lit(index(spark, sf_dir, "documents").search_q("src3").total()).cast("long").alias("count"))


# Folder indices


def folder_catalog(spark: SparkSession) -> Catalog:
    """A catalog in a new folder of the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "findling-shared")
    return Catalog(spark, f"{base.rstrip('/')}/findling/indices-{uuid.uuid4().hex[:12]}")


@add("publish_then_sql", "SELECT o_orderstatus, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY 1")
def _(spark, sf_dir):
    held = folder_catalog(spark)
    held.index("orders", create=True).publish(table(spark, sf_dir, "orders"), "o_orderkey")
    held.settings("orders", {"dynamic": "false"})
    return held.index("orders").frame().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max(F.to_timestamp("o_orderdate")).cast("timestamp_ntz").alias("last"))


@add("publish_in_order", "SELECT CAST(user_id AS VARCHAR) AS _id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id * 7919 % 1000003 DESC) = 1")
def _(spark, sf_dir):
    held = folder_catalog(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 1000003).alias("rank"))
    held.index("events", create=True).publish(rows, "user_id", order="rank")
    return held.index("events").frame().select("_id", "event_id")


@add("update_documents", "SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_custkey % 3 = 0 THEN 'MOVED' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name FROM customer")
def _(spark, sf_dir):
    held = folder_catalog(spark).create("customer", {"segment": "keyword", "name": "keyword"})
    rows = table(spark, sf_dir, "customer")
    held.publish(rows.select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name")), "c_custkey")
    held.update_all(rows.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("_id"), F.lit('{"segment": "MOVED", "name": null}').alias("patch")))
    held.compact()
    return held.frame()


@add("bulk_files_latest", "SELECT CAST(user_id AS VARCHAR) AS _id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf_dir):
    held = folder_catalog(spark)
    action = F.concat(F.lit('{"index": {"_id": "'), F.col("user_id").cast("string"), F.lit('"}}'))
    body = table(spark, sf_dir, "events").select("event_id", F.concat_ws("\n", action, F.to_json(F.struct("event_id", "event_type"))).alias("value"))
    body.orderBy("event_id").select("value").write.text(f"{held.root}.bodies")
    index = held.index("events", create=True)
    index.bulk_files(f"{held.root}.bodies")
    return index.frame().select("_id", "event_id", "event_type")


@add("verify_files", "SELECT 'ok' AS status, count(*) AS rows FROM orders")
def _(spark, sf_dir):
    held = folder_catalog(spark).create("orders", {"o_orderstatus": "keyword"})
    held.publish(table(spark, sf_dir, "orders"), "o_orderkey")
    return held.verify().groupBy("status").agg(F.sum("rows").alias("rows"))


@add("text_match_pruned", f"SELECT doc_id, lang FROM documents WHERE list_has_all({toks('text')}, ['anthat', 'the'])")
def _(spark, sf_dir):
    held = folder_catalog(spark)
    table(spark, sf_dir, "documents").repartitionByRange(16, "doc_id").write.parquet(f"{held.root}/table")
    TermFiles(spark, f"{held.root}/terms").build(f"{held.root}/table", ["text"])
    held.register_files("documents", f"{held.root}/table", ("text",), "doc_id", f"{held.root}/terms")
    return held.sql("SELECT doc_id, lang FROM documents WHERE text_match(text, 'anthat AND the')")
