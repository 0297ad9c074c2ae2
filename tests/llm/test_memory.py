"""What the pipeline's workers hold, and how many files its tables of a round have."""

from __future__ import annotations

import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quarryline.llm import _runtime, quality, simhash

from .test_near_dedup import firsts


def resident_mb() -> float:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_quality_arrays_stay_small_on_a_large_batch():
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(3000))
    texts = pa.array([text[i:] for i in range(700)])
    tracemalloc.start()
    try:
        quality.measure(texts)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 10e6 and peak < 80


def test_a_task_gives_freed_memory_back():
    if not Path("/proc/self/status").exists() or not hasattr(_runtime.ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs glibc on Linux")

    def run(batches):
        held = [np.ones(8000) for _ in range(3000)]  # 64 KB each, below what is mapped by itself
        pins.append(np.ones(8000))  # keeps the top of the heap
        held.clear()
        seen.append(resident_mb())
        yield from batches

    pins, seen = [], []
    assert list(_runtime.lean(run)([1, 2])) == [1, 2]
    assert seen[0] - resident_mb() > 100


def test_few_rows_have_few_files_whatever_the_partitions(spark):
    rng = random.Random(6)
    texts = {}
    for k in range(40):
        words = [f"g{k}x{i}" for i in range(120)]
        for i in range(4):
            own = list(words)
            own[rng.randrange(120)] = f"h{i}"
            texts[4 * k + i] = own
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    files = lambda: {p for p in Path(re.sub("^file:/+", "/", spark.sparkContext._jsc.sc().getCheckpointDir().get())).rglob("part-*")}
    _runtime.durable(spark.range(1))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        old = files()
        got = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
        new = files() - old
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == firsts(texts)
    assert len(new) < 400  # of 48 partitions each the tables would have over 1000
