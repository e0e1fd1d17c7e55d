import json

from findling.console import run
from findling.sources.exchange import from_ipc, to_ipc, to_ndjson


def test_console(voyages):
    out = list(run(voyages, ["SELECT harbour, count(*) AS n FROM voyages\n", "GROUP BY harbour ORDER BY n DESC, harbour LIMIT 1;\n", "SELECT nothing FROM voyages;", "\\watch 0", "\\q", "SELECT 1;"], watch_turns=2))
    assert "brest   | 4" in out[0] and "(1 rows" in out[0]
    assert out[1].startswith("sql_execution_exception") and len(out) == 4


def test_exchange(spark, voyages):
    df = voyages.sql("SELECT skipper, miles, nullif(harbour, 'kiel') AS h FROM voyages ORDER BY miles LIMIT 5")
    again = from_ipc(spark, to_ipc(df))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    frames = [json.loads(x) for x in to_ndjson(df, 2)]
    assert frames[0]["columns"] == ["skipper", "miles", "h"] and sum(len(f["rows"]) for f in frames[1:]) == 5
