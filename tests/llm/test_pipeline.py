"""The corpus pipeline on the smallest tables: each stage's effect."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from fieldglass.llm import pii, quality  # noqa: E402

from .test_operators import brute_components  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == names
        after.append({r.doc_id: r.text for r in docs.collect()})
    first, second, third, fourth = after
    kept = {r.doc_id for r in quality.quality_verdicts(spark.read.parquet(f"{DATA}/documents.parquet")).collect() if r.kept}
    assert set(first) == kept
    groups = brute_components(list(first.items()), 5, 80, 100)
    assert set(second) == {c for _, c in groups.values()}
    assert all(third[i] == pii.redact(t) for i, t in second.items()) and not any(re.search(r"\w@\w+\.\w", t) for t in third.values())
    assert fourth == third
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in last} == set(fourth)


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _row long, _tag string, _key long, _position long, size long, tag string"


def odd_rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    text = lambda: " ".join(word() for _ in range(rnd.randint(60, 90)))
    base, other = text(), text()
    near = base.replace(base.split()[30], "changed", 1)
    docs = [
        (1, base),
        (1, other),
        (2, base),
        (2, base),
        (None, near),
        (None, other),
        (None, text()),
        (3, None),
        (4, ""),
        (4, ""),
        (None, None),
        (5, text()),
        (5, text()),
        (6, "short one"),
        (6, "short one")
    ]
    docs += [(10 + i, text()) for i in range(30)]
    return [(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or ""), k, "x", k, k, k, "y") for k, (i, t) in enumerate(docs)], base, other


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, empty texts and clashing names: what each stage keeps, against plain Python."""
    rows, base, other = odd_rows()
    docs = spark.createDataFrame(rows, NAMES)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r["doc_id"], r["text"])
    kept = stages["quality rules"](spark, docs, DATA)
    assert kept.columns == docs.columns
    want = Counter((i, t) for i, t, *_ in rows if t and len(t.split()) >= 20)
    assert Counter(map(key, kept.collect())) == want  # so few rows get no verdict but the base rule's

    first = stages["n-gram Jaccard join"](spark, docs, DATA)
    assert first.columns == docs.columns
    groups = brute_components([(k, r[1]) for k, r in enumerate(rows)], 5, 80, 100)
    members = {}
    for k, (n, c) in groups.items():
        members.setdefault(c if n else -1 - k, []).append(rows[k][:2])
    got = [key(r) for r in first.collect()]
    assert len(got) == len(members)
    for m in members.values():
        ids = [i for i, _ in m if i is not None]
        assert any(x in m and x[0] == (min(ids) if ids else None) for x in got)
    assert Counter(got)[(1, base)] == 1 and (2, base) not in got and Counter(got)[(4, "")] == 2

    for name in ("PII", "mixing sources"):
        out = stages[name](spark, docs, DATA)
        assert out.columns == docs.columns and Counter(map(key, out.collect())) == Counter((i, t) for i, t, *_ in rows)
    packed = stages["best-fit packing"](spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, DATA)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns)


def test_sequences_follow_the_mixed_order(spark):
    from fieldglass.llm import mixing, packing
    from fieldglass.llm.queries import tokenizer_file

    rnd = random.Random(5)
    rows = [(i, " ".join("word" for _ in range(rnd.randint(100, 1900))), "abc"[min(2, int(rnd.expovariate(1)))]) for i in range(150)]
    docs = mixing.with_positions(spark.createDataFrame(rows, "doc_id long, text string, source string"), "at", block_bytes=4000).cache()
    place = {r.doc_id: r["at"] for r in docs.collect()}
    got = packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), order="at").collect()
    first, by_length = {}, {}
    for r in got:
        first[r.sequence_id] = min(place[r.doc_id], first.get(r.sequence_id, 10**9))
        by_length.setdefault(r.length, []).append(place[r.doc_id])
    assert sorted(first) == list(range(len(first))) and [first[s] for s in sorted(first)] == sorted(first.values())
    assert sorted(place.values()) == list(range(150))


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() > 50
