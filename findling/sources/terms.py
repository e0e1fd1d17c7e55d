"""Which files of a table hold which terms, so that text clauses read only files that can match.

The index is a table ``(field, term, file)`` in the order of terms, so that looking a term up reads a few row groups. It
is built once for a table's files; files that came later are simply always read. It says where matches can be, never
what matches: the clause itself still decides row by row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import ident, tokens_sql
from ..functions.query_string import Needs


class TermFiles:
    """The index of one table in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, table: str, fields: list[str]) -> TermFiles:
        """Indexes the text fields of a Parquet table. Each task gives a term once for each of its files."""
        rows = self.spark.read.parquet(table).select(F.col("_metadata.file_path").alias("file"), *(F.col(ident(f)) for f in fields))
        each = None
        for f in fields:
            own = rows.select(F.lit(f).alias("field"), F.explode(F.expr(f"array_distinct({tokens_sql(ident(f))})")).alias("term"), "file").distinct()
            each = own if each is None else each.union(own)
        each.repartitionByRange("field", "term", "file").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{self.path}/terms")
        rows.select("file").distinct().write.mode("overwrite").parquet(f"{self.path}/files")
        return self

    def candidates(self, needs: Needs) -> set[str] | None:
        """The indexed files that can match, or None for all; the names of files are all that comes to the driver."""
        out: set[str] | None = None
        held = self.spark.read.parquet(f"{self.path}/terms")
        for some in needs:
            test = F.lit(False)
            for f, t in sorted(some):
                test = test | ((F.col("field") == f) & (F.col("term") == t))
            files = {r["file"] for r in held.where(test).select("file").distinct().toLocalIterator()}
            out = files if out is None else out & files
        return out

    def kept(self, files: list[str], needs: Needs) -> list[str]:
        """Of a table's files those that can match, and those that the index doesn't know."""
        found = self.candidates(needs) if needs else None
        if found is None:
            return files
        known = {self._plain(r["file"]) for r in self.spark.read.parquet(f"{self.path}/files").toLocalIterator()}
        gone = known - {self._plain(x) for x in found}
        return [x for x in files if self._plain(x) not in gone]

    @staticmethod
    def _plain(uri: str) -> str:
        """One spelling of a file's name, whatever the slashes after its scheme."""
        scheme, found, rest = uri.partition(":")
        return f"{scheme}:/{rest.lstrip('/')}" if found else uri
