"""The pipeline, stage by stage, against the plain versions of its decisions."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from findling.llm import _kernel as K
from findling.llm import bpe, crf, quality, repeats
from findling.llm._shared import Workspace

from . import brute
from .conftest import words
from .test_operators import check_packing


def test_stages(spark, docs, tmp_path):
    columns = docs.columns
    held = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held, "").write.parquet(f"{tmp_path}/{name}")
        before, held = held, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), held.collect())
        if name != "packing":
            assert held.columns == columns
    before, after = seen["language"]
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before if r["doc_id"] < 150} <= kept
    assert not any(r["doc_id"] in kept for r in before if not any(c.isalpha() for c in r["text"] or ""))
    before, after = seen["quality"]
    _, verdict = brute.judge([(r["lang"], r["source"], r["text"]) for r in before], quality)
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r, k in zip(before, verdict, strict=True) if k}
    before, after = seen["near_duplicates"]
    assert {r["doc_id"] for r in after} == {c for _, c in brute.components([(r["doc_id"], r["text"]) for r in before]).values()}
    before, after = seen["repeats"]
    left = {r["doc_id"]: r["text"] for r in after}
    expected = brute.repeats([(r["doc_id"], r["text"]) for r in before], repeats.PASSAGE_BYTES)
    assert left == {r["doc_id"]: x[4] for r, x in zip(before, expected, strict=True)} and any(x[1] for x in expected)
    before, after = seen["packing"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = {r["doc_id"]: bpe.library(path).encode(r["text"], add_special_tokens=False).ids for r in before}
    bins = check_packing(after, ids)
    assert bins <= np.ceil(sum(len(x) + 1 for x in ids.values()) / 2048) + 1


def test_memory_of_a_step():
    """What a worker takes follows the step, not the batch: two workers an executor, beside the heap."""
    rng = random.Random(6)
    texts = [words(rng, 400) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert batch.nbytes > 3 << 20
    model = crf.Model(["de", "en", "es", "fr"])
    whole = crf._judge(model, *K.flatten(batch.column(0)))
    for _ in K.steps(iter([batch.slice(0, 1)])):  # tables that stay are there before
        K.prefix_hash(np.zeros(9, np.uint8))
    tracemalloc.start()
    try:
        labels, scores = [], []
        for _, raw, at in K.steps(iter([batch])):
            label, score, _ = crf._judge(model, raw, at)
            labels += label
            scores.append(score)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert labels == whole[0] and np.allclose(np.concatenate(scores), whole[1])
    assert peak < 24 << 20, f"{peak >> 20} MB"


def test_estimates_are_joined_by_numbers(spark, docs):
    """A broadcast of a few rows with a string as key takes a page of tens of MB in each executor; steps have many."""

    class Seen(Workspace):
        kinds = {}

        def save(self, df, name, partition_by=None):
            self.kinds[name] = dict(df.dtypes)
            return super().save(df, name, partition_by)

    space = Seen(spark, "test")
    rows = quality.judged(docs, space).where("grp is not null").select("grp").distinct().collect()
    assert rows and all(r["grp"][0] in "fc*" for r in rows)
    states = [kinds for name, kinds in space.kinds.items() if name.startswith("state-") or name == "numbered"]
    assert len(states) > 2 and all(kinds["grp"] == "int" for kinds in states)
