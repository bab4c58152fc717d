"""The pipeline's stages in their order, each against plain Python on what its predecessor kept."""

import hashlib
import re

import corpus_pipeline
from dossier.llm import langid
from dossier.llm.queries import tokenizer_path
from tests.llm.test_ngram_join import _brute


def _rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_stages(spark, docs, tmp_path):
    import tokenizers

    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        before = table
        table = stage(spark, before, "")
        table.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, table)
        if name != "bpe":
            assert table.columns == docs.columns

    before, after = kept["language_id"]
    model = langid.learn(docs.where(~langid.held_out()))
    fits = lambda t: (lambda j: j[0] != "und" and j[2] >= 0.5)(langid.judge(model, t))
    assert _rows(after) == [r for r in _rows(before) if fits(r[1])]

    before, after = kept["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in _rows(before):
        key = norm(r[1])
        first[key] = min(first.get(key, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((norm(r[1]), (r[0] is None, r[0] or 0)) for r in _rows(after)) == sorted(first.items())

    before, after = kept["ngram_join"]
    own = [(r[0], r[1]) for r in _rows(before)]
    stay = {i for i, n, c in _brute(own, 5, 80, 100) if not n or c == i}
    assert {r[0] for r in _rows(after)} - {None} == stay

    before, after = kept["mixing"]
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows)
    assert set(_rows(after)) <= set(_rows(before))
    assert size(_rows(after)) <= 3 * size(_rows(before))

    before, after = kept["bpe"]
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    want = []
    for r in _rows(before):
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), " ".join(map(str, ids)), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert _rows(after) == sorted(want, key=repr)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_join", "mixing", "bpe"]
