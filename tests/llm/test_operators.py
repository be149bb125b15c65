"""Corpus operators against brute force on a small table with every edge case."""

import hashlib
import itertools
import random
import re
import shutil
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import jaccard, langid, mixing, packing, pii, quality, sharding, shingles, sketch, suffix_dedup, token_store, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, row long"
SPACE = r"[^\x20\x09-\x0D]+"


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base, passage = text(200), text(90)
    out = [None, "", " \n\t ", "one", "a b c", "x" * 500, "ab " * 300, "Äöü ß é", "line\nline\nline\n \n", passage]
    out += [base] * 9 + [text(rnd.randint(20, 120)) for _ in range(60)]
    for i in range(12):
        w = base.split(" ")
        w[i * 7] = "changed"
        out.append(" ".join(w))
    out += [f"{text(30)} {passage} {text(10)}" for _ in range(8)] + [text(3000)]
    out += ["mail jo@ex.org or 10.0.0.1 +1 (555) 123-4567 and 4111 1111 1111 1111", "jo at ex dot org"]
    ids = list(range(0, 3 * len(out), 3))
    rnd.shuffle(ids)
    return [
        (
            i,
            t,
            None if k % 11 == 0 else ("en" if k % 2 else "fr"),
            None if k % 13 == 0 else f"s{k % 3}",
            1,
            7,
            9,
            5
        ) for k, (i, t) in enumerate(zip(ids, out, strict=True))
    ]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(t):
    return (t or "").encode()


def test_sharding(docs, empty, spark):
    got = sharding.shard_documents(docs, 4).collect()
    text = {r[0]: r[1] for r in ROWS}
    assert len(got) == len(ROWS)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len(raw(text[r.doc_id])) + 1 and r.text_crc32 == zlib.crc32(raw(text[r.doc_id])) for r in got)
    groups = {}
    for r in got:
        groups.setdefault(text[r.doc_id] or "", set()).add(r.shard)
    assert all(len(v) == 1 for v in groups.values())
    assert sharding.shard_documents(empty, 4).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(200)], "doc_id long, text string")
    got = sharding.shard_documents(hot, 8).collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes.values()) == {25}
    assert len({r.shard for r in got if r.doc_id % 2}) == 4  # a hundred copies fill four shards of 25


def even(sizes, n):
    return len(sizes) == n and max(sizes.values()) - min(sizes.values()) <= 1


def test_sharding_joins_pairs_beside_a_hot_text(spark):
    rows = ["hot"] * 800 + [f"pair {i}" for i in range(480) for _ in range(2)] + [f"alone {i}" for i in range(640)]
    random.Random(3).shuffle(rows)
    got = sharding.shard_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert even(Counter(r.shard for r in got), 16)
    groups = {}
    for r in got:
        groups.setdefault(rows[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for k, v in groups.items() if k != "hot") and len(groups["hot"]) <= 10


def test_sharding_of_a_graph(spark):
    rnd = random.Random(4)
    edges = [(8 * c + a, 8 * c + b) for c in range(40) for a in range(8) for b in range(a) if rnd.random() < 0.8]  # forty communities of eight
    edges += [(rnd.randrange(320), rnd.randrange(320)) for _ in range(30)]
    nodes = spark.createDataFrame([(i,) for i in range(500)], "node long").cache()
    members = sharding.edge_links(spark.createDataFrame(edges, "a long, b long")).cache()
    placed = sharding.balanced_label_propagation(nodes, members, 5).cache()
    shard = {r.node: r.shard for r in placed.collect()}
    assert len(shard) == 500 and even(Counter(shard.values()), 5)
    distinct = {tuple(sorted(e)) for e in edges if e[0] != e[1]}
    cut = sum(shard[a] != shard[b] for a, b in distinct)
    told = sharding.cut_links(placed, members).agg(F.sum("cut"), F.count("*")).first()
    assert told == (cut, len(distinct)) and cut < 0.35 * len(distinct)  # by chance it is 0.8


def test_quality_counts(docs, empty):
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, min_rows=20).collect()}
    for i, t, *_ in ROWS:
        w = re.findall(SPACE, t or "")
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality.quality_verdicts(empty).count() == 0


def test_quality_rejects_outliers(spark):
    rnd = random.Random(2)
    clean = [
        (
            i,
            " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(60)).capitalize(),
            "en",
            "s"
        ) for i in range(300)
    ]
    junk = [(1000 + i, " ".join(f"W{rnd.randint(0, 9999)}!!###" for _ in range(60)), "en", "s") for i in range(20)]
    got = {
        r.doc_id: r.kept for r in quality.quality_verdicts(
            spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
        ).collect()
    }
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_quality_rejects_few_words(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rnd.randint(50, 90))), "en", "s") for i in range(300)]
    junk = [(1000 + i, " ".join(w for _ in range(8) for w in [word()] * 8), "en", "s") for i in range(10)]  # no window of eight words comes twice
    got = {
        r.doc_id: r for r in quality.quality_verdicts(
            spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
        ).collect()
    }
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(10))


def test_quality_converges(spark):
    rng = np.random.default_rng(7)
    p, rows = len(quality.NAMES), []
    for g, shift in (("a", 3.0), ("b", 1.0)):
        x = np.concatenate([rng.normal(0, 1, (900, p)), rng.normal(shift, 2, (600, p))])
        rows += [(g, [*map(int, v)]) for v in np.round(x * quality.UNIT)]
    v = spark.createDataFrame(rows, "g string, x array<int>").cache()
    est = quality.mcd_estimates(v, quality.Scratch(spark, "test"), p)
    scale = 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, p), p + 2)
    assert est.count() == 2
    for r in est.collect():  # one more step by numpy doesn't lower the determinant
        x = np.array([t[1] for t in rows if t[0] == r.g]) / quality.UNIT
        low = np.zeros((p, p))
        low[np.tril_indices(p)] = r.low
        b = np.floor(np.log1p((np.linalg.solve(low, (x - r.m).T) ** 2).sum(0)) * 1024)
        cov = np.cov(x[b <= np.ceil(np.percentile(b, 75))].T, bias=True) * scale + np.diag(np.square(list(quality.FLOORS.values())))
        assert np.linalg.slogdet(cov)[1] / 2 > r.h - 1e-3


def test_quality_verdict_by_hand(spark):
    """Distances and verdicts from a plain numpy run of the same steps."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, min_rows=1).collect()}
    stats = quality.vectors(quality.text_statistics(docs)).collect()
    p, groups = len(quality.NAMES), {}
    floor = np.array(list(quality.FLOORS.values()))
    scale = 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, p), p + 2)
    for r in stats:
        groups.setdefault((r.lang, r.source), []).append(r)
    for rows in groups.values():
        raw = np.array([r.x for r in rows])
        x, c = raw / quality.UNIT, np.percentile(raw, 50, axis=0)
        m, cov = c / quality.UNIT, np.diag(np.maximum(np.percentile(abs(raw - c), 50, axis=0) * 1.4826 / quality.UNIT, floor) ** 2)
        last, first = None, True
        while True:
            d = ((x - m) * np.linalg.solve(cov, (x - m).T).T).sum(1)
            h = np.linalg.slogdet(cov)[1] / 2
            if not first and last is not None and last[2] - h < 1e-6:
                m, cov, _ = last
                break
            last = (m, cov, h) if not first else None
            b = np.floor(np.log1p(d) * 1024)
            inner = x[b <= np.ceil(np.percentile(b, 75))]
            m, cov, first = inner.mean(0), np.cov(inner.T, bias=True).reshape(p, p) * scale + np.diag(floor**2), False
        d = ((x - m) * np.linalg.solve(cov, (x - m).T).T).sum(1)
        for r, want in zip(rows, d, strict=True):
            assert abs(got[r.doc_id].distance - want) < 1e-6 * max(1, want)
            assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and want <= quality.chi2_quantile(1 - 1e-6, p))


def test_chi2():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.975, 2), 2) - 0.975) < 1e-9 and abs(quality.chi2_quantile(0.95, 1) - 3.8414588) < 1e-5


def test_suffix_dedup(docs, empty):
    length = 200
    seen = Counter(raw(t)[k : k + length] for _, t, *_ in ROWS for k in range(len(raw(t)) - length + 1))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length).collect()}
    for i, t, *_ in ROWS:
        b = raw(t)
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (
            len(b),
            int(gone.sum()),
            spans,
            hashlib.sha256(kept).hexdigest()
        ), (i, (t or "")[:40])
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("shard", [600, 8])  # the second names ranges by two bytes
def test_suffix_dedup_splits_heavy_keys(docs, monkeypatch, shard):
    whole = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()} == whole


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(97, 99 + seed, 400).astype(np.uint8)
    order, b = suffix_dedup.suffix_array(t), t.tobytes()
    assert [b[i:] for i in order] == sorted(b[i:] for i in range(len(b)))
    lcp = suffix_dedup.common_prefixes(t, order, 9)
    for x, y, n in zip(order, order[1:], lcp, strict=False):
        k = 0
        while k < 9 and x + k < len(b) and y + k < len(b) and b[x + k] == b[y + k]:
            k += 1
        assert k == n


ODD = [
    "",
    " ",
    "  a  b",
    "a\n b",
    "x\t y",
    "it's  'll",
    "a.b,c. d",
    "x ,y",
    "wait... no.",
    "(a). b,",
    "é.É,\nB.",
    "a\x1cb",
    "<|endoftext|> x",
    "1 22  333\r\n4",
    "A. B, c"
]
ODD += ["İ.", "İ,", "a\n\nb", "\n\n", "क़.", "x\n", "a .", "\u3000 a", "a\xa0 b\n\xa0c"]


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_encoder_equals_library(name, kind, monkeypatch):
    rnd = random.Random(9)
    alphabet = [
        *"abcXYZ019 .,,..  \n\n\t'-_!?()",
        "İ",
        "ß",
        "é",
        "e\u0301",
        "\u0307",
        "ſ",
        "K",
        "क़",
        "ন",
        "ﬁ",
        "\xa0",
        "\u2003",
        "\x85",
        "\x1c",
        "文",
        "😀",
        "٣",
        "²",
        "Σ",
        "'s",
        " the",
        "\r\n",
        "\x0b",
        "\u200b",
        "\0",
        "<|endoftext|>"
    ]
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    monkeypatch.setattr(tokens, "SLICE", 5000)
    monkeypatch.setattr(tokens, "CACHE", 30_000)  # forgets on the way
    e = tokens.Encoder(public_tokenizers.path(name), kind)
    want = e.library.encode_batch_fast(texts, add_special_tokens=False)
    for t, ids, w in zip(texts, e.encode_texts(texts), want, strict=True):
        assert ids.tolist() == w.ids, t


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_encoder_finds_hash_collisions(kind, monkeypatch):
    e = tokens.Encoder(public_tokenizers.path(f"{kind}_bpe_{'50' if kind == 'byte' else '49'}k.json"), kind)
    plain = e._hashes
    monkeypatch.setattr(e, "_hashes", lambda b, s, t: (plain(b, s, t)[0] % np.uint64(5) + np.uint64(1), plain(b, s, t)[1]))
    texts = ["one two three four five six seven", "eight nine ten"]
    assert [x.tolist() for x in e.encode_texts(texts)] == [x.ids for x in e.library.encode_batch_fast(texts, add_special_tokens=False)]


def test_token_store(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = tokens.Encoder(path, "byte").library
    got = token_store.store_documents(docs, path).orderBy("doc_id").collect()
    at = 0
    for (i, t), r in zip(sorted(((x[0], x[1]) for x in ROWS), key=lambda x: x[0]), got, strict=True):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) == (i, at, len(ids), zlib.crc32(ids.tobytes()), True)
        at += len(ids)
    assert token_store.store_documents(empty, path).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50000, 40000).astype("<u2")
    b = np.concatenate([rng.integers(0, 50000, 777).astype("<u2"), a])
    ends = lambda *x: token_store.cut_points(np.concatenate(x), np.cumsum([0, *map(len, x)])).tolist()
    cut = lambda x: [x[s:e].tobytes() for s, e in itertools.pairwise([0, *ends(x)])]
    assert ends(b, a, a[:0], a[:5]) == [*ends(b), *(len(b) + e for e in ends(a)), len(b) + len(a) + 5]
    flat = np.ones(3 * token_store.LONGEST, "<u2")
    assert ends(flat[:16], flat)[-1] == len(flat) + 16 and max(np.diff(ends(flat[:16], flat))) <= token_store.LONGEST
    assert b"".join(cut(a)) == a.tobytes() and max(map(len, cut(a))) <= 2 * token_store.LONGEST
    assert len(set(cut(a)) & set(cut(b))) > 0.9 * len(cut(a))
    assert token_store.merkle_root([b"a", b"b"]) != token_store.merkle_root([b"b", b"a"])


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokens.Encoder(path, "word").library
    got = packing.pack_documents(docs, path).collect()
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in ROWS}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, x in ids.items():
        p = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in p] == [(k, 2048 * k) for k in range(len(p))] and sum(r.length for r in p) == len(x)
    for p in by_seq.values():
        p.sort(key=lambda r: r.offset)
        assert [r.offset for r in p] == [sum(q.length for q in p[:k]) for k in range(len(p))] and sum(r.length for r in p) <= 2048
    assert len(by_seq) == packing.lower_bound(Counter(r.length for r in got), 2048)
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion(seed):
    rnd = random.Random(seed)
    counts = Counter(rnd.randint(10, 95) for _ in range(rnd.randint(3, 9)))
    plan = packing.bin_completion(counts, 100)
    used = Counter()
    for fill, times in plan:
        assert sum(fill) <= 100
        for n in fill:
            used[n] += times
    assert used == counts
    items = sorted(counts.elements(), reverse=True)

    def fits(k):  # exact, by trying each item in each bin
        bins = [100] * k

        def go(i):
            if i == len(items):
                return True
            for b in {bins[j]: j for j in range(k)}.values():
                if bins[b] >= items[i]:
                    bins[b] -= items[i]
                    if go(i + 1):
                        return True
                    bins[b] += items[i]
            return False

        return go(0)

    n = sum(k for _, k in plan)
    assert not fits(n - 1)


@pytest.mark.parametrize("times", [1, 4, 1000])
def test_bin_completion_of_many_rows(times):
    counts = {1032: 6 * times, 528: 6 * times, 520: 6 * times, 496: 12 * times}
    plan = packing.bin_completion(counts)
    assert sum(k for _, k in plan) == packing.lower_bound(counts, 2048) == 9 * times
    used = Counter()
    for fill, k in plan:
        assert sum(fill) <= 2048
        for n in fill:
            used[n] += k
    assert used == counts


def test_bin_completion_fillings_with_gaps():
    have = packing.Lengths({60: 2, 50: 1, 33: 2, 30: 3}, 100)
    assert set(packing.fillings(have, 98)) >= {(60, 33), (33, 33, 30)} and have.left[60] == 2  # 93 by two or 96 by three; none is full


def test_pii(docs, empty):
    for _, t, *_ in ROWS:
        want = []
        for k, p in pii.PATTERNS.items():
            for m in p.finditer(t or ""):
                d = re.sub("[^0-9]", "", m[0])
                ok = {
                    "email": True,
                    "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 12 <= len(d) <= 19 and pii.luhn(d),
                    "phone": 9 <= len(d) <= 15
                }[k]
                if ok:
                    want.append((m.start(), m.end(), k))
        assert sorted(pii.base_spans(t or "")) == sorted(want)
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    full = next(r for r in ROWS if r[1] and r[1].startswith("mail jo"))
    r = got[full[0]]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    worded = next(r for r in ROWS if r[1] == "jo at ex dot org")
    assert got[worded[0]].n_email == 0 and got[worded[0]].spans == "email:0:16"
    assert pii.find_personal_data(empty).count() == 0
    red = {x.doc_id: x.text for x in pii.redact_documents(docs).collect()}
    assert red[worded[0]] == "[EMAIL]" and "jo@ex.org" not in red[full[0]] and red[next(r[0] for r in ROWS if r[1] is None)] is None


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("іаn@еxample.com", "email", "іаn@еxample.com"), ("jo [at] ex [dot] com", "email", "jo [at] ex [dot] com"), (
            "card ４１１１ １１１１ １１１１ １１１１ x",
            "card",
            "４１１１ １１１１ １１１１ １１１１"
        ),
        (
            "call plus one five five five one two three four five now",
            "phone",
            "plus one five five five one two three four five"
        ), ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
        ("jo[@]ex[.]com", "email", "jo[@]ex[.]com"), (
            "jo [at] ex dot com",
            "email",
            "jo [at] ex dot com"
        ), ("jo at ex [dot] com", "email", "jo at ex [dot] com"), ("jo@ex dot com", "email", "jo@ex dot com"),
        ("to jo at ex.com!", None, None), ("to jo.doe at ex.com!", "email", "jo.doe at ex.com"), ("look at example.com today", None, None),
        ("he is at ex.com", None, None), ("meet at noon dot the end", None, None), ("jo at ex dot com", "email", "jo at ex dot com"), (
            "go to one nine two dot one six eight dot zero dot one.",
            "ip",
            "one nine two dot one six eight dot zero dot one"
        ), ("one dot two dot three", None, None), (
            "192 dot 168 dot 0 dot 1",
            "ip",
            "192 dot 168 dot 0 dot 1"
        ), ("jo at ex Punkt de", "email", "jo at ex Punkt de"), ("jо аt ex dоt com", "email", "jо аt ex dоt com"),
        (
            "mail jo@ex.com dot matrix",
            None,
            None
        ), ("see us at www.ex.com", None, None), ("a dot b dot c", None, None), ("look at this.That is", None, None),
        ("we met at noon. Then", None, None), ("one two three", None, None),
    ],
)
def test_deobfuscation(text, kind, found):
    spans = pii.added_spans(text, pii.base_spans(text))
    assert [(k, text[s:e]) for s, e, k in spans] == ([(kind, found)] if kind else [])


@pytest.mark.parametrize(
    "text",
    [
        "-" * 10**6 + " dot ",
        ". " * 300_000 + " dot x",
        "1" * 10**6,
        "a at b dot " * 90_000,
        "1 " * 400_000,
        "+1" + "(" * 10**6,
        "x@" * 300_000,
        "[at] " * 200_000,
        "1.1.1." * 100_000
    ]
)
def test_pii_takes_linear_time(text):
    began = time.process_time()
    pii.added_spans(text, pii.base_spans(text))
    assert time.process_time() - began < 20


def brute_components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_jaccard(docs, empty, k, num, monkeypatch):
    monkeypatch.setattr(jaccard, "LOT", 2000)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, k, (num, 100)).collect()}
    assert got == brute_components([r[:2] for r in ROWS], k, num, 100)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_chains(spark):
    rnd = random.Random(8)
    rows, w = [], [f"w{rnd.randint(0, 10**6)}" for _ in range(120)]
    for i in range(60):  # each text is near the one before, not near the first
        w = list(w)
        w[rnd.randrange(len(w))] = f"v{i}"
        rows.append((i * 2, " ".join(w)))
    got = {
        r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(
            spark.createDataFrame(rows, "doc_id long, text string"),
            4,
            (85, 100)
        ).collect()
    }
    assert got == brute_components(rows, 4, 85, 100)


def test_shingles():
    assert len(shingles.shingle_set("a b c d e", 4)) == 2 and len(shingles.shingle_set("a b", 4)) == 1 and len(shingles.shingle_set(" \n", 4)) == 0
    assert (
        shingles.shingle_set("A b  c\td", 2) == shingles.shingle_set("a B c d", 2)
    ).all() and not np.isin(shingles.shingle_set("x y", 2), shingles.shingle_set("y x", 2)).any()


def test_sketch(docs, empty):
    got = {r.doc_id: r for r in sketch.fingerprint_documents(docs, rows_each=7).collect()}
    order = sorted(((r[0], r[1] or "") for r in ROWS), reverse=True)
    assert len(got) == len(ROWS)
    for k, (i, t) in enumerate(order):
        j, nxt = order[(k + 1) % len(order)]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (
            {x[k : k + 12] for k in range(0, len(x), 12)} for x in (
                y.split(":")[2] for y in (r.fingerprint, r.edited_fingerprint, got[j].fingerprint)
            )
        )
        like = lambda x, y, same: 1.0 if same else len(x & y) / len(x | y) if x | y else 0.0
        assert r.near_edited == like(a, b, t == edited) and r.near_next == like(a, c, t == nxt)
    assert len({got[r[0]].fingerprint for r in ROWS if r[1] == ROWS[10][1]}) == 1
    assert sketch.fingerprint_documents(empty).count() == 0


def test_sketch_follows_true_jaccard(spark):
    """Likeness beside the exact Jaccard measure of the five-word shingles, for short and long texts."""
    rnd = random.Random(12)
    rows, errors = [], {}
    for i in range(0, 600, 2):
        w = [f"w{rnd.randint(0, 10**9)}" for _ in range(rnd.choice([20, 40, 60, 200, 900]))]
        k = rnd.randint(0, len(w) // 3)
        rows += [(i + 1, " ".join(w)), (i, "  ".join([*w[k:], *(f"v{rnd.randint(0, 10**9)}" for _ in range(k))]))]
    text = dict(rows)
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    got = {r.doc_id: r for r in sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), rows_each=50).collect()}
    for i in range(1, 600, 2):
        true = len(sets[i] & sets[i - 1]) / len(sets[i] | sets[i - 1])
        errors.setdefault(len(sets[i]) < 100, []).append(abs(got[i].near_next - true))
        e = got[i].fingerprint.split(":")
        assert int(e[0], 16) == len(text[i].split()) - 4 and len(e[2]) % 12 == 0
    assert np.mean(errors[True]) < 0.06 and np.mean(errors[False]) < 0.02


def test_sketch_with_one_doc_id(spark):
    """Rows that share a doc_id, or have none, are dealt to intervals by their texts, and each row has a neighbour."""
    rows = [
        (7, f"{i} text number of a hot id") for i in range(60)
    ] + [(None, f"{i} is a text without id") for i in range(60)] + [(i, f"{i} other text") for i in range(20)]
    got = sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), rows_each=5).collect()
    assert len(got) == len(rows)
    text = Counter((i, len(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_chars) for r in got) == text
    assert all(r.near_edited is not None and r.near_next is not None for r in got)
    kept = {t: {hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for _, n in rows} for _, t in rows}
    assert Counter(min(t for _, t in rows if r.edited_sha256 in kept[t]) for r in got) == Counter(t for _, t in rows)


def test_sketch_estimates_containment(spark):
    rnd = random.Random(3)
    w = [f"w{rnd.randint(0, 10**9)}" for _ in range(20000)]
    one = spark.createDataFrame([(" ".join(w), " ".join(w[:4000]))], "a string, b string").select(
        sketch.kept_hashes(F.col("a")).alias("a"),
        sketch.kept_hashes(F.col("b")).alias("b")
    )
    r = one.select(
        sketch.containment(F.col("b.h"), F.col("a.h")).alias("all"),
        sketch.containment(F.col("a.h"), F.col("b.h")).alias("fifth"),
        F.size("a.h").alias("n")
    ).first()
    assert getattr(r, "all") > 0.99 and abs(r.fifth - 0.2) < 0.03 and abs(r.n / 20000 - 1 / sketch.SCALE) < 0.02


def test_language(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10**7, None, "en"), (10**7 + 1, "123 !?", "en"), (10**7 + 2, "", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    got = langid.identify_languages(both).join(both.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & (got.doc_id < 10**7)]
    assert (held.lang == held.lang_pred).mean() > 0.97 and set(got[got.doc_id >= 10**7].lang_pred) == {"und"}
    assert got.score.between(0, 1).all()
    for i, h in zip(got.doc_id, got.held_out, strict=True):
        assert h == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert langid.identify_languages(empty).count() == 0


def test_language_decoding_by_hand(spark):
    """Features, margins and decoding of the learned model by plain loops."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn(docs.filter("doc_id % 2 = 0 AND lang IS NOT NULL AND text IS NOT NULL"), 30)
    langs, code, w, b = model
    got = {r.doc_id: r for r in langid.predict_languages(docs.withColumn("held_out", F.lit(True)), model).collect()}
    for i, t, _ in docs.limit(25).collect():
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].ambiguous) == ("und", 0, True)
            continue
        raw, grams = f" {t} ".encode(), Counter()
        for n in (2, 3, 4):
            for at in range(len(raw) - n + 1):
                h = raw[at] * 2654435761 % 2**32
                for c in raw[at + 1 : at + n]:
                    h = (h ^ c) * 2246822519 % 2**32
                    h ^= h >> 15
                grams[h >> 20] += 1
        total = sum(grams.values())
        margins = [sum((k / total) ** 0.5 * float(w[f, j]) for f, k in grams.items()) + float(b[j]) for j in range(code.shape[1])]
        loss = [sum(max(0, 1 - min(4, max(-4, m)) * c) for m, c in zip(margins, row, strict=True)) / len(row) for row in code.tolist()]
        first, second = sorted(loss)[:2]
        assert got[i].lang_pred == langs[loss.index(first)] and abs(got[i].score - min(1, (second - first) / max(second, 1e-9))) < 1e-3
        assert got[i].ambiguous == (got[i].score < langid.AMBIGUOUS)


def test_mixing(docs, empty):
    got = sorted(mixing.mix_sources(docs, block_bytes=300, quantum=64).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(ROWS)))
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    shares = {r.source: r.share for r in got}
    assert sum(shares.values()) == 64
    blocks = {s: -(-n // 300) for s, n in sizes.items()}
    for s, q in shares.items():  # the slot of each block lies in its window
        for r in got:
            if r.source == s:
                assert r.block * 64 // q <= r.slot < -(-(r.block + 1) * 64 // q)
    assert max(r.block for r in got) < max(blocks.values())
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_order(empty).count() == 0
    assert sorted(r.doc_id for r in mixing.mixed_order(docs, block_bytes=300).collect()) == sorted(r[0] for r in ROWS)


def test_mixing_by_hand(spark):
    """Positions from a plain earliest-deadline-first loop over the blocks."""
    rnd = random.Random(6)
    rows = [(i, "abcd"[min(3, int(rnd.expovariate(1)))], "x" * rnd.randint(0, 120)) for i in range(400)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_bytes=300, quantum=64).collect()
    share = {r.source: r.share for r in got}
    had, slots = dict.fromkeys(share, 0), {}
    for t in range(64 * (1 + max(r.slot for r in got) // 64)):
        due = [(-(-(had[s] + 1) * 64 // q), s) for s, q in share.items() if had[s] * 64 // q <= t]
        _, s = min(due)
        slots[s, had[s]] = t
        had[s] += 1
    assert all(r.slot == slots[r.source, r.block] and r.block == r.source_start // 300 for r in got)
    starts = {s: sorted((r.source_start, r.size) for r in got if r.source == s) for s in share}
    assert all(b[0] == a[0] + a[1] for x in starts.values() for a, b in itertools.pairwise(x))
    order = sorted(got, key=lambda r: (r.slot, r.source_start))
    assert [r.position for r in order] == list(range(400))


def test_mixing_many_sources_and_clashing_names(spark):
    rows = [(None if i % 7 == 0 else i // 2, f"s{i % 1100}", f"text {i // 2}", i, i) for i in range(2300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _key long, _position long")
    got = mixing.mix_sources(docs).collect()
    assert sorted(r.position for r in got) == list(range(2300)) and sum({r.source: r.share for r in got}.values()) == 4096
    back = mixing.mixed_order(docs)
    assert back.columns == docs.columns and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_pfair_deviation(spark):
    shares = [40, 13, 7, 3, 1]
    got = {r.slot: r.number for r in mixing.pfair_period(spark, shares).collect()}
    q = sum(shares)
    assert sorted(got) == list(range(q))
    had = [0] * len(shares)
    for t in range(q):
        had[got[t]] += 1
        assert all(abs(h - w * (t + 1) / q) < 1 for h, w in zip(had, shares, strict=True))
    assert had == shares


def test_repeated_rows(spark):
    rows = [(1, "some words that are here twice or so " * 3, "en", "s")] * 2 + [
        (2, "other", "en", "s"),
        (None, "null id", None, None),
        (None, "null id", None, None),
        (None, None, None, None)
    ]
    twice = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert sharding.shard_documents(twice, 2).count() == 6 and quality.quality_verdicts(twice).count() == 6 and pii.find_personal_data(twice).count() == 6
    assert mixing.mix_sources(twice).count() == 6 and packing.pack_documents(twice, path, "byte").count() == 6 and suffix_dedup.remove_repeats(twice).count() == 6
    assert jaccard.jaccard_components(twice).count() == 6 and langid.identify_languages(twice).count() == 6
    lib = tokens.Encoder(path, "byte").library
    got = sorted(token_store.store_documents(twice, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, 1, 1, 2] and all(r.verified for r in got)
    ids = {(d, zlib.crc32(np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t, *_ in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == ids and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(6)]
    marks = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(twice, 5).collect()}
    assert marks[1][1] == 1 and marks[2] == (1, 2) and marks[None][1] is None
    prints = sketch.fingerprint_documents(twice, rows_each=1).collect()
    assert len(prints) == 6 and len({r.fingerprint for r in prints if r.doc_id == 1}) == 1
    none = twice.filter("doc_id IS NULL")
    assert sketch.fingerprint_documents(none, rows_each=1).count() == 3 and token_store.store_documents(none, path).count() == 3 and langid.identify_languages(none).count() == 3


def test_store_finds_changes(docs, spark, tmp_path):
    """A changed payload, recipe or manifest is found when the store is read."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(docs, str(tmp_path / "good"), path, "byte", 2)
    assert all(r.verified for r in token_store.read_store(spark, str(tmp_path / "good")).collect())

    def broken(part, change):
        to = tmp_path / part.replace("/", "-")
        shutil.copytree(tmp_path / "good", to)
        table = spark.read.parquet(str(tmp_path / "good" / part))
        shutil.rmtree(to / part)
        change(table).write.parquet(str(to / part))
        got = token_store.read_store(spark, str(to)).collect()
        assert len(got) == len(ROWS)
        return sum(not r.verified for r in got)

    flip = lambda c: F.concat(F.substring(c, 1, 1).cast("binary"), F.unhex(F.lit("00")), F.substring(c, 3, 10**9).cast("binary"))
    one = spark.read.parquet(str(tmp_path / "good/chunks/kind=1")).agg(F.min("digest")).first()[0]
    assert broken(
        "chunks/kind=1",
        lambda t: t.withColumn("payload", F.when(F.col("digest") == one, F.unhex(F.lit("0102"))).otherwise(F.col("payload")))
    ) >= 1
    some = ROWS[20][0]
    assert broken("recipes", lambda t: t.withColumn("digests", F.when(F.col("doc_id") == some, F.array(F.lit(one))).otherwise(F.col("digests")))) >= 1
    assert broken("manifest/packs", lambda t: t.withColumn("root", flip("root"))) == len(ROWS)
    assert broken("manifest/groups", lambda t: t.withColumn("root", flip("root"))) == len(ROWS)


def test_disguises_found_and_prose_left_alone():
    """Recall on planted disguises and precision on the prose around them."""
    rnd = random.Random(6)
    prose = "we look at the plan and meet at noon dot by dot, one two or three of us at home. see example.com or ask at the desk".split()
    names, hosts, ends = ["anna", "j.smith", "kim7", "max_m", "lee"], ["mail", "post-box", "acme", "uni"], ["com", "org", "de", "fr"]
    spell = dict(zip("0123456789", ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"], strict=True))
    hits = found = 0
    for _ in range(400):
        words = [rnd.choice(prose) for _ in range(rnd.randint(8, 25))]
        n, h, e = rnd.choice(names), rnd.choice(hosts), rnd.choice(ends)
        octets = [str(rnd.randint(10, 255)) for _ in range(4)]
        hidden = rnd.choice(
            [f"{n} at {h} dot {e}", f"{n} [at] {h} [dot] {e}", f"{n}(at){h}.{e}", f"{n}@{h} dot {e}", " dot ".join(octets), " dot ".join(" ".join(spell[d] for d in o) for o in octets)]
        )
        text = " ".join([*words, "write", hidden, "today", *words])
        spans = [text[s:e] for s, e, _ in pii.added_spans(text, pii.base_spans(text))]
        hits += hidden in spans
        found += len(spans)
    assert hits >= 0.98 * 400 and found <= 1.02 * hits
