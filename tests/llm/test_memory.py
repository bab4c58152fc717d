"""Python workers give back what they have freed."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from dossier.llm.common import letting_go


def _held() -> float:
    """MB of this process."""
    return int(re.search(r"\nRss:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_freed_memory_is_let_go():
    def run(batches):
        for batch in batches:
            parts = [np.ones(60_000, np.uint8) for _ in range(3_000)]  # below the size that is mapped, and so given back, by itself
            kept.extend(parts[::500])  # lies between and behind what is freed
            kept.append(np.ones(60_000, np.uint8))
            del parts
            yield batch

    batch, kept = pa.record_batch({"id": [1]}), []
    before = _held()
    assert list(run(iter([batch]))) == [batch]
    assert _held() - before > 100
    assert list(letting_go(run)(iter([batch]))) == [batch]
    assert _held() - before < 60
