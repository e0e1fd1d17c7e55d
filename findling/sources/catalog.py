"""The catalog of indices and its SQL entry."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..errors import IllegalArgument, IndexExists, IndexNotFound, ParsingError, SearchError
from ..mapping import _NAME, Mapping, check_index_name
from ..plans.sql import SqlPlan, compile_sql, run_sql
from .bulk import parse_ndjson
from .index import Index
from .storage import Folder
from .terms import TermFiles

_COMMAND = re.compile(r"""^\s*(?:(?P<show>SHOW\s+(?:TABLES|INDICES))|(?:DESCRIBE|DESC)\s+(?P<describe>\S+)|SHOW\s+CREATE\s+TABLE\s+(?P<create>\S+))\s*;?\s*$""", re.I)
_EXPLAIN = re.compile(r"^\s*EXPLAIN\s+(?P<analyze>ANALYZE\s+)?", re.I)


class Catalog:
    """Indices by name. ``root`` is the folder of indices that take writes."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.indices: dict[str, Index] = {}

    def create(self, name: str, mappings: dict | None = None, settings: dict | None = None) -> Index:
        check_index_name(name)
        if name in self.indices:
            raise IndexExists(f"index [{name}] already exists")
        if self.root is None:
            raise IllegalArgument("this catalog has no folder for indices")
        settings = dict(settings or {})
        body = dict(mappings or {})
        self.indices[name] = Index(self, name, Mapping.of(body, str(settings.get("dynamic", "false"))), None, settings)
        return self.indices[name]

    def register(self, name: str, df: DataFrame, text: tuple[str, ...] = (), key: str | None = None) -> Index:
        """A table as a read-only index; ``_id`` is ``key`` as text (or an existing ``_id``)."""
        check_index_name(name)
        mapping = Mapping.of_schema(df.schema, text)
        if key is not None:
            df = df.withColumn("_id", df[key].cast("string"))
        self.indices[name] = Index(self, name, mapping, df, {})
        return self.indices[name]

    def register_files(self, name: str, path: str, text: tuple[str, ...] = (), key: str | None = None, terms: str | None = None) -> Index:
        """A Parquet table as a read-only index. ``terms`` is the folder of an index of its terms (``TermFiles``), by which
        unscored text clauses read only the files that can match."""
        index = self.register(name, self.spark.read.parquet(path), text, key)
        if terms is not None:
            index.files = (path, key, TermFiles(self.spark, terms))
        return index

    def known(self) -> list[str]:
        """Names of all indices, those that only the folder knows among them."""
        stored = [n for n in Folder(self.spark, self.root).names() if Folder(self.spark, f"{self.root}/{n}").exists("_index.json")] if self.root else []
        return sorted({*self.indices, *stored})

    def exists(self, name: str) -> bool:
        if name not in self.indices and self.root and _NAME.match(name) and (index := Index.open(self, name)) is not None:
            self.indices[name] = index
        return name in self.indices

    def index(self, name: str, create: bool = False) -> Index:
        """An index; ``create`` makes it on first use, as the first write does."""
        if not self.exists(name):
            if create:
                return self.create(name, {"dynamic": "true"})
            raise IndexNotFound(f"no such index [{name}]")
        return self.indices[name]

    def drop(self, name: str) -> None:
        index = self.index(name)
        if index.given is None:
            index.folder.delete()
        del self.indices[name]

    def settings(self, name: str, change: dict | None = None) -> dict:
        """Settings of an index with its dynamic mode; the engine can't change."""
        index = self.index(name)
        for key, value in (change or {}).items():
            if key == "engine":
                raise IllegalArgument("[engine] can't be changed")
            if key == "dynamic":
                index.mapping = Mapping(index.mapping.fields, str(value), index.mapping.dimensions)
            else:
                index.settings[key] = value
        if change and index.given is None:
            index._commit()
        return {"dynamic": index.mapping.dynamic, **index.settings}

    # Metadata

    def show_tables(self) -> DataFrame:
        rows = [(n, "local_shards" if x.given is None else "table", x.frame().count(), len(x.mapping.fields)) for n, x in ((n, self.index(n)) for n in self.known())]
        return self.spark.createDataFrame(rows, "index string, engine string, docs long, fields int")

    def describe(self, name: str) -> DataFrame:
        mapping = self.index(name).mapping
        rows = [(n, k + (f"({mapping.dimensions[n]})" if n in mapping.dimensions else "")) for n, k in sorted(mapping.fields.items())]
        return self.spark.createDataFrame(rows, "field string, type string")

    def show_create(self, name: str) -> DataFrame:
        index = self.index(name)
        body = {"settings": index.settings, "mappings": index.mapping.body()}
        return self.spark.createDataFrame([(name, json.dumps(body, sort_keys=True))], "index string, create_body string")

    def cat_indices(self) -> DataFrame:
        return self.show_tables()

    def cat_segments(self) -> DataFrame:
        """The batches of all folder indices: ``index, generation, batch, files, bytes``."""
        rows = [x for n in self.known() if self.index(n).given is None for x in self.index(n).segments()]
        return self.spark.createDataFrame(rows, "index string, generation int, batch string, files int, bytes long")

    def bulk(self, body: str) -> DataFrame:
        """Indexes a body whose actions name their indices; one that isn't there is made. One row for each item in order."""
        items = list(enumerate(parse_ndjson(body)))
        by: dict[str, list[tuple[int, dict]]] = {}
        refused = []
        for i, item in items:
            try:
                by.setdefault(self.index(check_index_name(item["index"] or ""), create=True).name, []).append((i, item))
            except SearchError:
                refused.append((i, item["index"], item["_id"], 400))
        done = sorted(refused + [r for name, own in by.items() for r in self.index(name)._bulk(own)])
        return self.spark.createDataFrame(done, "item int, _index string, _id string, status int")

    # SQL

    def sql(self, text: str, strict: bool = False) -> DataFrame:
        return self.run(text, strict)[0]

    def run(self, text: str, strict: bool = False) -> tuple[DataFrame, SqlPlan | None]:
        """The DataFrame of a statement, and what the planner understood of a query."""
        if command := _COMMAND.match(text):
            name = (command["describe"] or command["create"] or "").strip('"`').rstrip(";").strip('"`')
            if command["show"]:
                return self.show_tables(), None
            return (self.describe(name) if command["describe"] else self.show_create(name)), None
        if found := _EXPLAIN.match(text):
            facts = self.explain(text[found.end() :], bool(found["analyze"]), strict)
            return self.spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "plan string"), None
        return run_sql(self.spark, text, lambda n, needs: self.index(n).frame_for(needs), lambda n: self.index(n).mapping, strict, self.exists)

    def stream(self, text: str, strict: bool = False) -> Iterator[str]:
        """NDJSON frames: one of metadata, then one for each row, partition by partition."""
        df, plan = self.run(text, strict)
        yield json.dumps({"meta": {"columns": df.columns, **({} if plan is None else plan.facts())}})
        for row in df.toJSON().toLocalIterator():
            yield '{"row":' + row + "}"

    def explain(self, text: str, analyze: bool = False, strict: bool = False) -> dict:
        """The logical facts and Catalyst's plan; ``analyze`` runs it and adds time and rows."""
        import time

        plan = compile_sql(text, lambda n: self.index(n).mapping, strict, known=self.exists)
        df, _ = self.run(text, strict)
        facts = {**plan.facts(), "physical_plan": df._jdf.queryExecution().explainString(self.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))}
        if analyze:
            began = time.time()
            facts["rows"] = df.count()
            facts["timings"] = {"total_ms": round(1000 * (time.time() - began), 1)}
        return facts


__all__ = ["Catalog", "ParsingError"]
