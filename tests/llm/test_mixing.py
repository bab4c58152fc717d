import itertools
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import mixing as m


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_fit_is_nearest(lengths, budget):
    sizes = sorted(lengths)
    counts = [lengths[s] for s in sizes]
    taken = m.fit(sizes, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    sums = {sum(s * k for s, k in zip(sizes, ks, strict=True)) for ks in itertools.product(*[range(c + 1) for c in counts])}
    share = [c * budget // max(1, sum(s * c for s, c in zip(sizes, counts, strict=True))) for c in counts]
    if budget < sum(s * c for s, c in zip(sizes, counts, strict=True)):  # among the sums that hold the shares
        reach = {x for ks in itertools.product(*[range(t, c + 1) for t, c in zip(share, counts, strict=True)]) for x in [sum(s * k for s, k in zip(sizes, ks, strict=True))]}
        assert abs(sum(s * t for s, t in zip(sizes, taken, strict=True)) - budget) == min(abs(x - budget) for x in reach)
    assert sum(s * t for s, t in zip(sizes, taken, strict=True)) in sums


def test_long_lengths_use_the_window():
    sizes, counts = [3, 70, 900, 12_000], [4000, 500, 300, 90]
    budget = 777_777
    taken = m.fit(sizes, counts, budget, window=50_000)
    assert sum(s * t for s, t in zip(sizes, taken, strict=True)) == budget


def test_mix(docs, rows, none):
    out = m.mix(docs).collect()
    again = m.mix(docs.repartition(5)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == len(rows)
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [s for s in size if s is None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(size.values()), set()
    while True:
        rate = (total - sum(3 * size[s] for s in capped)) / max(1e-9, sum(weight[s] for s in order if s not in capped))
        over = {s for s in order if s not in capped and weight[s] * rate > 3 * size[s]}
        if not over:
            break
        capped |= over
    aims = {size[s]: (3.0 * size[s] if s in capped else weight[s] * rate) for s in order}
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - aims[r.source_size]) < 1e-6
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
        taken[r.source_size] += r.taken
    longest = max(r.size for r in out)
    assert all(abs(taken[s] - aims[s]) <= longest for s in taken)
    assert m.mix(none).count() == 0
    mixed = m.mixed_documents(docs)
    assert mixed.columns == docs.columns
