"""A worker that has done its task keeps little memory."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import re
import numpy as np, pyarrow as pa
from brindle.llm import toxicity

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

machine = toxicity.Machine(np.zeros(0, np.int64), -30.0, np.zeros(0), np.zeros((0, toxicity.RANK)))
batches = lambda n: (pa.record_batch({"doc_id": pa.array(range(4000)), "text": pa.array([f"{i} " + "x" * 4000 for i in range(4000)])}) for _ in range(n))
clean = toxicity._clean(machine, 0.3)
assert sum(b.num_rows for b in clean(batches(1))) == 4000  # what the first use loads
pa.default_memory_pool().release_unused()
before = held()
assert sum(b.num_rows for b in clean(batches(6))) == 24000
print(held() - before)
"""


def test_idle_worker_gives_memory_back():
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 12
