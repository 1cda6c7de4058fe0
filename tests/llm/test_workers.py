"""What a Python worker still holds once its task is over."""

from __future__ import annotations

import subprocess
import sys

import pytest

#: Runs a worker function over 24 MB of text in a process of its own; prints the MB that it then holds more than before.
TASK = """
import ctypes, random, re
import pyarrow as pa
import public_tokenizers
from modengine.llm import bagminhash, mixing, packing, substring

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

seeds = pa.schema([("block", pa.int64()), *[(c, pa.binary()) for c in ("docs", "crcs", "starts", "lengths", "seeds", "spans")]])
run = {
    "pieces": lambda: packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 2048),
    "seeds": lambda: substring._seed_scan(20, 6, 4, {}, seeds),
    "counts": lambda: substring._seed_counts(20, 6, 4),
    "multisets": lambda: bagminhash._multisets,
    "measure": lambda: mixing._measure(1, [0], ["doc_id", "words", "features"]),
}[NAME]()

def batch(n, size):
    rng = random.Random(n)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(5000)]
    return pa.record_batch({"doc_id": list(range(n)), "text": [" ".join(rng.choices(words, k=size)) for _ in range(n)]})

list(run(iter([batch(4, 50)])))  # what is loaded once does not count
texts = batch(4000, 1000)
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = held()
for _ in run(iter([texts])):
    pass
print(held() - before)
"""


@pytest.mark.parametrize("name", ["pieces", "seeds", "counts", "multisets", "measure"])
def test_idle_workers_give_back_what_a_task_needed(name):
    done = subprocess.run([sys.executable, "-c", f"NAME = {name!r}\n{TASK}"], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 12
