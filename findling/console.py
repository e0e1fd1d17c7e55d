"""A small SQL console: statements end with a semicolon; ``\\watch N`` repeats the last one, ``\\q`` leaves.

``python -m findling.console NAME=PATH[:TEXT,FIELDS[:KEY]] ...`` opens Parquet tables as indices.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable

from .errors import SearchError
from .sources.catalog import Catalog

#: Rows shown of a result.
SHOWN = 50


def table_text(columns: list[str], rows: list[tuple]) -> str:
    """A result as aligned text."""
    cells = [columns, *[["NULL" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    line = lambda r: " | ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(cells[0]), "-+-".join("-" * w for w in width), *map(line, cells[1:])])


def run(catalog: Catalog, lines: Iterable[str], watch_turns: int | None = None) -> Iterable[str]:
    """Answers to the statements in ``lines``."""
    held, last = "", None

    def answer(text: str) -> str:
        began = time.time()
        try:
            df = catalog.sql(text)
            rows = [tuple(r) for r in df.limit(SHOWN + 1).collect()]
        except SearchError as e:
            return f"{e.kind}: {e}"
        more = " or more" if len(rows) > SHOWN else ""
        return f"{table_text(df.columns, rows[:SHOWN])}\n({min(len(rows), SHOWN)}{more} rows, {time.time() - began:.2f} s)"

    for line in lines:
        if not held and line.strip() == "\\q":
            return
        if not held and line.strip().startswith("\\watch"):
            pause = float((line.split() + ["2"])[1])
            turn = 0
            while last and (watch_turns is None or turn < watch_turns):
                yield answer(last)
                turn += 1
                time.sleep(pause)
            continue
        held += line if line.endswith("\n") else line + "\n"
        while ";" in held:
            statement, held = held.split(";", 1)
            if statement.strip():
                last = statement.strip()
                yield answer(last)
        held = held if held.strip() else ""


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("findling").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalog = Catalog(spark)
    for arg in args:
        name, _, rest = arg.partition("=")
        path, *more = rest.split(":") if "://" not in rest else [rest]
        text = tuple(more[0].split(",")) if more and more[0] else ()
        catalog.register(name, spark.read.parquet(path), text, more[1] if len(more) > 1 else None)
    for out in run(catalog, sys.stdin):
        print(out, flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
