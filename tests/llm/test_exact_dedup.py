import hashlib
import re
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from dossier.llm import exact_dedup as e


@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=60), st.integers(0, 62))
def test_golomb_round_trip(values, k):
    values = np.array(sorted(values), np.uint64)
    k = max(k, e.rice_parameter(len(values), 1 << 64) if len(values) else k)
    assert e.golomb_decode(e.golomb_encode(values, k), len(values), k).tolist() == values.tolist()


def test_groups(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    out = e.exact_dedup(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=key) == sorted(want, key=key)
    kept = [r for r in out if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert e.exact_dedup(none).count() == 0
    stays = e.kept_documents(docs)
    assert stays.columns == docs.columns and stays.count() == len(groups)
