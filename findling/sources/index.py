"""An index: versions of documents in Parquet, of which the latest of each id count.

A folder index holds ``_index.json`` (mapping, settings, generation) and one folder for each generation, in which every batch of
versions has a folder of its own. A batch is written under a hidden name and renamed when whole, so readers see all
of it or nothing; its files' row counts and checksums go to the generation's digests, which ``verify`` compares with what
the files hold. ``compact`` writes the next generation beside the current one and switches by the small file alone.
"""

from __future__ import annotations

import json
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentMissing, IllegalArgument, SearchError, StrictMapping
from ..functions.query_string import Needs
from ..mapping import Mapping
from ..operators import SearchResult, count, search, translate
from ..operators.search import sort_keys
from .bulk import bulk_rows, learned, parse_ndjson
from .readers import columns_of
from .storage import Folder
from .terms import TermFiles

if TYPE_CHECKING:
    from .catalog import Catalog

#: A version: the batch that brought it and its place there, whether it deletes, and the document's JSON.
LOG = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_seq", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_deleted", T.BooleanType()), T.StructField("_source", T.StringType())])
DIGESTS = "file string, rows long, checksum long"
#: Bytes of a file that compaction writes.
FILE_BYTES = 128 << 20


def latest(versions: DataFrame, key: str = "_id", seq: str | list[str] = "_seq", deleted: str = "_deleted") -> DataFrame:
    """The newest version of every key that isn't a tombstone; of equally new ones the greatest by its other columns.

    An aggregate with map-side combining, so a key with very many versions is reduced before the exchange.
    """
    rest = [c for c in versions.columns if c != key]
    order = [seq] if isinstance(seq, str) else seq
    best = versions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest).alias("_tie"))).alias("_best"))
    rows = best.select(key, "_best.*")
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))).select(*[c for c in versions.columns if c != deleted]) if deleted in versions.columns else rows.select(*versions.columns)


def overlay(versions: DataFrame, updates: DataFrame, key: str = "_id") -> DataFrame:
    """Partial updates by presence: ``updates`` has (key, patch map of new JSON values); a present null overwrites."""
    joined = versions.join(updates, key, "left")
    merged = F.when(F.col("patch").isNull(), F.col("fields")).otherwise(F.map_concat(F.map_filter("fields", lambda k, v: ~F.array_contains(F.map_keys("patch"), k)), F.col("patch")))
    return joined.select(key, merged.alias("fields"))


class Index:
    """One index of a catalog. Over a given DataFrame it is read-only; over a folder it keeps versions."""

    def __init__(self, catalog: Catalog, name: str, mapping: Mapping, frame: DataFrame | None, settings: dict):
        self.catalog, self.name, self.mapping, self.given, self.settings = catalog, name, mapping, frame, settings
        self.spark, self.pending, self.seq, self.generation = catalog.spark, [], 0, 0
        self.files: tuple[str, str | None, TermFiles] | None = None
        if frame is None:
            self.folder = Folder(self.spark, f"{catalog.root}/{name}")
            stored = self.folder.read_json("_index.json")
            self.generation = stored["generation"] if stored else 0
            self._commit()
            self.seq = (self._log().agg(F.max("_seq")).first()[0] or 0) + 1

    @classmethod
    def open(cls, catalog: Catalog, name: str) -> Index | None:
        """The index that a folder of the catalog's root holds."""
        stored = Folder(catalog.spark, f"{catalog.root}/{name}").read_json("_index.json") if catalog.root else None
        return None if stored is None else cls(catalog, name, Mapping.of(stored["mappings"]), None, stored["settings"])

    @property
    def path(self) -> str:
        return f"{self.catalog.root}/{self.name}"

    def _commit(self) -> None:
        """Writes the small file that says what the index is."""
        self.folder.write_json("_index.json", {"mappings": self.mapping.body(), "settings": self.settings, "generation": self.generation})

    def _learn(self, fields: dict[str, str]) -> None:
        """Takes on fields of a batch, by the mapping's dynamic mode."""
        unknown = {n: k for n, k in fields.items() if n not in self.mapping.fields and n not in ("_id", "_score")}
        if self.mapping.dynamic == "strict" and unknown:
            raise StrictMapping(f"fields {sorted(unknown)} are not mapped and the mapping is strict")
        if self.mapping.dynamic == "true" and unknown:
            self.mapping = Mapping({**self.mapping.fields, **unknown}, self.mapping.dynamic, self.mapping.dimensions)
            self._commit()

    def _part(self, generation: int) -> str:
        return f"gen-{generation:06d}"

    def _stored(self, generation: int | None = None) -> DataFrame | None:
        part = self._part(self.generation if generation is None else generation)
        if not self.folder.names(part):
            return None
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{self.path}/{part}")

    def _log(self) -> DataFrame:
        stored = self._stored()
        return stored if stored is not None else self.spark.createDataFrame([], LOG)

    def _append(self, versions: DataFrame, generation: int | None = None) -> None:
        """Commits a batch of versions, and the digests of its files."""
        part = self._part(self.generation if generation is None else generation)
        name = f"b-{uuid.uuid4().hex}"
        versions.select(*LOG.names).write.parquet(f"{self.path}/{part}/.{name}")
        self.folder.rename(f"{part}/.{name}", f"{part}/{name}")
        written = self.spark.read.schema(LOG).parquet(f"{self.path}/{part}/{name}")
        self._digests(written).write.mode("append").parquet(f"{self.path}/digests-{part}")

    @staticmethod
    def _digests(log: DataFrame) -> DataFrame:
        own = log.select(F.element_at(F.split(F.input_file_name(), "/gen-"), -1).alias("file"), F.xxhash64(*LOG.names).alias("h"))
        return own.groupBy("file").agg(F.count("*").alias("rows"), F.bit_xor("h").alias("checksum"))

    def frame(self) -> DataFrame:
        """The live documents: ``_id`` and the mapped columns."""
        if self.given is not None:
            return self.given
        return columns_of(self.sources(), self.mapping)

    def frame_for(self, needs: Needs) -> DataFrame:
        """The rows that can match a clause with these needs: fewer files than ``frame`` reads, if the terms' places are known."""
        if self.files is None or not needs:
            return self.frame()
        path, key, terms = self.files
        whole = self.spark.read.parquet(path)
        kept = terms.kept(whole.inputFiles(), [x for x in needs if all(f in self.mapping.fields for f, _ in x)])
        rows = self.spark.read.schema(whole.schema).parquet(*kept) if kept else self.spark.createDataFrame([], whole.schema)
        return rows if key is None else rows.withColumn("_id", rows[key].cast("string"))

    def sources(self) -> DataFrame:
        """``_id`` and the JSON of the live documents."""
        return latest(self._log(), seq=["_seq", "_at"]).select("_id", "_source")

    # Writes

    def _write(self, rows: list[tuple[str, bool, str | None]]) -> None:
        self._writable()
        for key, deleted, source in rows:
            self.pending.append((key, self.seq, 0, deleted, source))
            self.seq += 1

    def _writable(self) -> None:
        if self.given is not None:
            raise IllegalArgument(f"index [{self.name}] is a view of a table and takes no writes")

    def refresh(self) -> None:
        """Makes single writes visible, as one batch of versions."""
        if self.pending:
            self._append(self.spark.createDataFrame(self.pending, LOG).coalesce(1))
            self.pending = []

    def compact(self, file_bytes: int = FILE_BYTES) -> None:
        """Rewrites the live documents, leaving versions and tombstones out, in files of about ``file_bytes``.

        The new generation stands whole before the index's small file names it; until then readers, and a run that
        breaks off, have the old one.
        """
        self.refresh()
        old, new = self.generation, self.generation + 1
        self.folder.delete(self._part(new))  # what a run that broke off has left
        self.folder.delete(f"digests-{self._part(new)}")
        files = max(1, -(-self.folder.size(self._part(old)) // file_bytes))
        live = latest(self._log(), seq=["_seq", "_at"]).withColumn("_deleted", F.lit(False))
        self._append(live.repartition(files, "_id"), new)
        self.generation = new
        self._commit()
        self.folder.delete(self._part(old))
        self.folder.delete(f"digests-{self._part(old)}")

    def put(self, doc: dict, id: str | None = None, refresh: bool = True) -> str:
        """Indexes a document; the same id replaces. Returns the id (a new one if none is given)."""
        doc = dict(doc)
        own = doc.pop("_id", None)
        key = id if id is not None else str(own) if own is not None else str(uuid.uuid4())
        self._writable()
        mapping = self.mapping.learn(doc)
        if mapping is not self.mapping:
            self.mapping = mapping
            self._commit()
        self._write([(key, False, json.dumps(doc, ensure_ascii=False))])
        if refresh:
            self.refresh()
        return key

    def get(self, id: str) -> dict | None:
        """The document of an id, or None."""
        self.refresh()
        if self.given is not None:
            row = self.given.where(F.col("_id") == id).first()
            return None if row is None else {k: v for k, v in row.asDict().items() if k != "_id"}
        row = latest(self._log().where(F.col("_id") == id), seq=["_seq", "_at"]).first()
        return None if row is None else json.loads(row["_source"])

    def update(self, id: str, doc: dict) -> dict:
        """Overlays top-level fields on a document; explicit nulls overwrite."""
        old = self.get(id)
        if old is None:
            raise DocumentMissing(f"[{id}]: document missing")
        new = {**old, **doc}
        self.put(new, id)
        return new

    def update_all(self, changes: DataFrame) -> None:
        """Overlays JSON objects on documents, without passing them through the driver: ``changes`` has (_id, patch).

        A present null overwrites; ids without a document are left out.
        """
        self._writable()
        self.refresh()
        parsed = lambda c: F.from_json(c, "map<string,variant>")
        merged = overlay(self.sources().select("_id", parsed("_source").alias("fields")), changes.select("_id", parsed("patch").alias("patch")))
        touched = merged.join(changes.select("_id").distinct(), "_id", "left_semi").select("_id", F.to_json("fields").alias("_source"))
        self._batch(touched.withColumn("_at", F.lit(0).cast("long")))

    def delete(self, id: str) -> bool:
        """Whether there was such a document."""
        found = self.get(id) is not None
        if found:
            self._write([(id, True, None)])
            self.refresh()
        return found

    def bulk(self, body: str) -> DataFrame:
        """Indexes a body; one row for each item in order: ``item, _index, _id, status``."""
        return self.spark.createDataFrame(self._bulk(list(enumerate(parse_ndjson(body, self.name)))), "item int, _index string, _id string, status int")

    def _bulk(self, items: list[tuple[int, dict]]) -> list[tuple[int, str, str, int]]:
        out = []
        for i, item in items:
            try:
                self.put(item["doc"], item["_id"], refresh=False)
                out.append((i, self.name, item["_id"], 201))
            except SearchError:  # a refused document doesn't stop the others
                out.append((i, self.name, item["_id"], 400))
        self.refresh()
        return out

    def _batch(self, rows: DataFrame) -> None:
        """Commits rows ``(_id, _at, _source)`` as the next batch."""
        self._append(rows.select("_id", F.lit(self.seq).cast("long").alias("_seq"), "_at", F.lit(False).alias("_deleted"), "_source"))
        self.seq += 1

    def bulk_files(self, path: str) -> None:
        """Indexes bulk bodies from files without passing them through the driver; later lines replace earlier ones."""
        self._writable()
        self.refresh()
        rows = bulk_rows(self.spark, path, f"{self.name}/{self.seq}")
        if self.mapping.dynamic != "false":
            self._learn(learned(rows))
        self._batch(rows)

    def publish(self, df: DataFrame, key: str, order: str | None = None) -> None:
        """Appends a table's rows as documents. Of rows with one key the one with the greatest ``order`` (a number or a time)
        counts; without an order, or with equal ones, the greatest by a hash of the document."""
        self._writable()
        self.refresh()
        self._learn(Mapping.of_schema(df.schema, tuple(df.columns)).fields)
        at = F.lit(0).cast("long")
        if order is not None:
            time = isinstance(df.schema[order].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)
            at = F.coalesce(F.unix_micros(F.col(order).cast("timestamp")) if time else F.col(order).cast("long"), F.lit(-(1 << 63)))
        self._batch(df.select(F.col(key).cast("string").alias("_id"), at.alias("_at"), F.to_json(F.struct(*[c for c in df.columns if c != "_id"])).alias("_source")))

    def verify(self) -> DataFrame:
        """Every file of versions against the digest that its batch committed: ``file, rows, checksum, status``.

        The status is ``ok``, ``changed``, ``missing`` (committed, but not there) or ``unknown`` (there, but never committed).
        """
        part = f"digests-{self._part(self.generation)}"
        known = self.spark.read.schema(DIGESTS).parquet(f"{self.path}/{part}") if self.folder.names(part) else self.spark.createDataFrame([], DIGESTS)
        found = self._digests(self._log()).select("file", F.struct("rows", "checksum").alias("is"))
        both = known.select("file", F.struct("rows", "checksum").alias("was")).join(found, "file", "full")
        status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "unknown").when(F.col("is") == F.col("was"), "ok").otherwise("changed")
        return both.select("file", F.coalesce("is.rows", "was.rows").alias("rows"), F.coalesce("is.checksum", "was.checksum").alias("checksum"), status.alias("status"))

    def segments(self) -> list[tuple[str, int, str, int, int]]:
        """(index, generation, batch, files, bytes) of every batch."""
        part = self._part(self.generation)
        return [(self.name, self.generation, b, *self.folder.weigh(f"{part}/{b}")) for b in sorted(self.folder.names(part))]

    # Reads

    def search(self, request: dict) -> SearchResult:
        sorted_by = [n for n, _ in sort_keys(request.get("sort", []))]
        unscored = sorted_by and "_score" not in sorted_by or request.get("size", 10) == 0  # scores count the whole table
        narrow = unscored and "knn" not in request and self.files is not None
        frame = self.frame_for(translate(request.get("query"), self.mapping).needs) if narrow else self.frame()
        return search(frame, request, self.mapping)

    def search_q(self, q: str, size: int = 10, start: int = 0) -> SearchResult:
        """``?q=``: ``*`` is all, else words on the catch-all."""
        query = {"match_all": {}} if q.strip() in ("", "*") else {"match": {"body": q}}
        return self.search({"query": query, "size": size, "from": start})

    def count(self, request: dict | None = None) -> int:
        frame = self.frame_for(translate((request or {}).get("query"), self.mapping).needs) if self.files is not None else self.frame()
        return count(frame, request, self.mapping).first()["count"]
