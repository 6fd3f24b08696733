"""What a Python worker still holds when a task is over: it serves other tasks and stages later."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np

from fieldloom.llm import suffix

WORKER = """
import re
import numpy as np
import pandas
import pyarrow as pa
from fieldloom.llm import common, suffix


class Docs:
    def mapInArrow(self, run, schema):
        return run


def held():
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\\s+(\\d+)", f.read())[1]) / 1024


def batch():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 2000, np.uint8).tobytes().decode() for _ in range(8000)]
    return pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array([0] * 8000), pa.array(texts)], ["doc_id", "base", "text"])


run, before = suffix._dealt(Docs(), 40, 100, 200_000, 16), held()
sum(b.num_rows for _ in range(2) for b in run(iter([batch()])))
common.powers(4 << 20)
list(run(iter([])))
print(held() - before, max(map(len, common._POWERS)))
"""


def test_a_worker_gives_back_what_a_task_held():
    out = subprocess.run([sys.executable, "-c", WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    megabytes, powers = map(float, out.stdout.split())
    assert megabytes < 40, megabytes
    assert powers <= 1 << 20


def test_transforms_of_a_group_take_few_bytes():
    # as many pieces as one key may have, each with an end in common with others
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 110, np.uint8).tobytes()
    texts = [rng.integers(97, 123, 25, np.uint8).tobytes() + shared[: 90 + i % 20] for i in range(suffix.GROUP_PIECES)]
    tracemalloc.start()
    doc, _ = suffix.repeated_windows(np.arange(len(texts)), np.zeros(len(texts), np.int64), texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(doc) and most < 110 * sum(map(len, texts)), most / sum(map(len, texts))
