"""The corpus queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, merkle
from .bpe import bpe_report
from .crf import language_report
from .merkle import fingerprint_report
from .packing import pack_documents
from .quality import quality_report
from .repeats import repeat_report
from .sketch_join import sketch_join
from .token_scan import token_report
from .warc import warc_report


#: The vocabulary files' folder; a parameter of the operators, never copied here.
BYTE_BPE = "byte_bpe_50k.json"


def vocabulary(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join(_table(spark, sf_dir, "documents"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_report(_table(spark, sf_dir, "documents"), vocabulary())


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(_table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_report(_table(spark, sf_dir, "pages"))


def op10_token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sketch_join": op1_sketch_join,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_merkle": op5_merkle,
    "op6_bpe": op6_bpe,
    "op7_language": op7_language,
    "op8_licenses": op8_licenses,
    "op9_warc": op9_warc,
    "op10_token_scan": op10_token_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_sketch_join": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM worded
), sized AS (
  SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM shingled
), single AS (
  SELECT doc_id, unnest(s) AS g FROM shingled
), overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM single a JOIN single b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT o.a, o.b FROM overlap o JOIN sized x ON x.doc_id = o.a JOIN sized y ON y.doc_id = o.b
  WHERE 100 * o.n >= 75 * (x.n_shingles + y.n_shingles - o.n)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION
  SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen
)
SELECT s.doc_id, s.n_shingles, min(r.seen) AS component_id FROM sized s JOIN reach r ON r.node = s.doc_id GROUP BY 1, 2
""",
    "op2_repeats": r"""
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), windows AS (
  SELECT doc_id, i, x[2 * i + 1 : 2 * i + 800] AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(0, len(x) // 2 - 399))) AS i FROM bytes)
), twice AS (
  SELECT hash(s) AS h FROM windows GROUP BY 1 HAVING count(*) > 1
), hits AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows WHERE hash(s) IN (SELECT h FROM twice)
), numbered AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits
), spans AS (
  SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM numbered GROUP BY 1, 2
), gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT s.doc_id, max(s.hi), any_value(len(b.x) // 2) FROM spans s JOIN bytes b USING (doc_id) GROUP BY 1
), kept AS (
  SELECT g.doc_id, string_agg(b.x[2 * g.lo + 1 : 2 * g.hi], '' ORDER BY g.lo) AS x,
         string_agg(regexp_replace(regexp_replace(b.x[2 * g.lo + 1 : 2 * g.hi], '^([89AB].){1,3}', ''), '([CD].|E.([89AB].)?|F.([89AB].){0,2})$', ''), '' ORDER BY g.lo) AS whole
  FROM gaps g JOIN bytes b USING (doc_id) GROUP BY 1
), removed AS (
  SELECT doc_id, sum(hi - lo) AS n, count(*) AS k FROM spans GROUP BY 1
)
SELECT b.doc_id, CAST(len(b.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.x, b.x))) AS kept_sha256, decode(unhex(coalesce(k.whole, b.x))) AS text
FROM bytes b LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)
""",
    "op5_merkle": merkle.oracle(),
    "op8_licenses": licenses.oracle(),
    "op9_warc": r"""
WITH digests AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages
), fives AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || x[5 * i + 1 : 5 * i + 5] AS BIGINT)) AS v FROM digests
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((n >> CAST(s AS INT)) & 31) AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM fives
""",
}
