"""Runs, conversations and SuperMinHash against brute force on small tables with every edge case."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from fieldglass.llm import conversations, oracle, runs, shingles, superminhash
from fieldglass.llm.queries import ORACLE_SQL

SPACE = r"[^\x20\x09-\x0D]+"


def brute_runs(w):
    """Every (start, length, period): islands of equal words q apart whose smallest period is q."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - a + q
            if i > a and n >= max(6, 4 * q) and not any(w[a : a + n - p] == w[a + p : a + n] for p in range(1, q)):
                out.append((a, n, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(SPACE, text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = {i for a, m, q in found for i in range(a + q, a + m)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(lines.encode()).hexdigest(), " ".join(x for i, x in enumerate(w) if i not in gone),
    )


def periodic(rnd, n, k):
    out = []
    while len(out) < n:
        w = [rnd.randrange(k) for _ in range(rnd.randint(1, 6))]
        out += w * rnd.choice([1, 1, 1, 4, 5, 7]) + w[: rnd.randint(0, len(w))]
    return out[:n]


def test_runs_of_numbers():
    rnd = random.Random(1)
    for _ in range(1500):
        w = periodic(rnd, rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 5, 40]))
        assert runs.word_runs(np.array(w, np.int64)) == brute_runs(w)
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    assert runs.word_runs(np.array(b)) == []  # Fibonacci words have exponents under 3.62
    assert runs.word_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert runs.word_runs(np.array(list(range(7)) * 9_000)) == [(0, 63_000, 7)]


def test_runs_search_again_after_equal_hashes():
    w = [1, 2, 3] * 40 + [9, 8, 7, 6]
    assert runs.stretch_runs(w, (0, *runs.BASES)) == [(0, 120, 3)]  # base 0 tells only the last word
    with pytest.raises(ArithmeticError):
        runs.stretch_runs([1] * 20 + [2] + [1] * 20, (1,))


def docs_of(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(6)]
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b " * 4, "x\x1cy " * 6, "é ß " * 5, "a  b\na\tb " * 3]
    texts += [" ".join(words[i] for i in periodic(rnd, rnd.randint(1, 120), rnd.randint(1, 6))) for _ in range(80)]
    texts += ["long " * 200_000, " ".join(f"n{i % 5000}" for i in range(60_000))]
    rows = [(None if i % 17 == 5 else i % 90, t, "clash", i) for i, t in enumerate(texts)]
    rows += rows[20:24]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, collapsed string, n_runs int")


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_runs_of_documents(spark):
    rows, docs = docs_of(spark)
    want = [brute_row(*r[:2]) for r in rows if len(r[1] or "") < 10_000]
    got = runs.collapse_runs(docs).collect()
    assert len(got) == len(rows)
    small = [r for r in got if len(r.collapsed) < 10_000 and (r.length or 0) < 10_000]
    assert plain(small) == plain(want)
    assert [(r.start, r.length, r.period, r.collapsed) for r in got if (r.length or 0) > 100_000] == [(0, 200_000, 1, "long")]
    assert runs.collapse_runs(docs.limit(0)).count() == 0


def test_runs_as_sql(spark):
    from pyspark.sql import functions as F

    rows, docs = docs_of(spark)
    rows = [r for r in rows if len(r[1] or "") < 10_000]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    want = con.execute(ORACLE_SQL["op11_runs"])
    cols = [c[0] for c in want.description]
    short = docs.filter("text IS NULL OR length(text) < 10000")
    got = runs.collapse_runs(short).withColumn("collapsed_sha256", F.sha2("collapsed", 256)).select(*cols)
    assert plain(got.collect()) == plain(want.fetchall())


def least_audits(rows):
    """(cost, audit) of the ASCII-least cheapest edits by trying all of them, cheapest first."""
    import heapq

    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles, audit) in seen or cost > 40:
            continue
        seen.add((i, roles, audit))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if len(roles) < len(rows) + 3:
            for x in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", i, roles + x))
        if i < len(rows):
            initial, fault, times = rows[i]
            heapq.heappush(heap, (cost + 3 * times, audit + "D", i + 1, roles))
            if fault not in (1, 2):
                t = fault == 3
                heapq.heappush(heap, (cost + t, audit + "K", i + 1, roles + (initial or "?")))
                for x in "ua":
                    heapq.heappush(heap, (cost + 2 + t, audit + "R", i + 1, roles + x))


def test_repair_is_cheapest_and_least():
    rnd = random.Random(3)
    for _ in range(400):
        rows = [(rnd.choice("suax"), rnd.choice([0, 0, 0, 1, 2, 3]), 1) for _ in range(rnd.randint(0, 5))]
        costs = conversations.cost_to_go(rows, conversations.END)
        edits, _ = conversations.walked(rows, costs, 0, True)
        assert (costs[0][0], "".join(x[1] for x in edits)) == least_audits(rows), rows


CONV = "conv_id long, turn long, role string, text string, at string, k int"


def conversation_rows():
    rnd = random.Random(11)
    out = []
    for c in [None, *range(40)]:
        for t in range(rnd.randint(1, 9)):
            turn = None if rnd.random() < 0.05 else t + (rnd.random() < 0.1)
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Hello.", "Yes!", "no end", "", None, " \n ", f"text {t}?", "é. ", "A.\nB"])
            out.append((c, turn, role, text, "clash", 1))
    out += [(77, t, ("user", "assistant")[t % 2], f"turn {t}.", "clash", 1) for t in range(600)]  # one hot conversation
    out += [(78, 4, "user", "same.", "clash", 1)] * 300 + [(79, 0, "user", "long " * 200_000 + ".", "clash", 1)]
    return out


def test_conversations_as_sql(spark):
    rows = conversation_rows()
    df = spark.createDataFrame(rows, CONV).repartition(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = con.execute(oracle.CONVERSATIONS)
    cols = [c[0] for c in want.description]
    assert plain(conversations.repair_conversations(df).select(*cols).collect()) == plain(want.fetchall())
    assert conversations.repair_conversations(df.limit(0)).count() == 0


def test_long_conversations_are_split(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        rnd = random.Random(2)
        roles = ["user", "assistant", "system", "tool"]
        rows = [(5, t, rnd.choice(roles), rnd.choice(["a.", f"b{t}", f"c{t}.", f"d{t}?", ""])) for t in range(400)]
        turns = conversations.repaired_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len({r["at"] >> 33 for r in turns}) > 5
    turns.sort(key=lambda r: (r["at"], r["k"]))
    seen, symbols = set(), []
    for _, _, role, text in rows:
        fault = 1 if not text else 2 if (role, text) in seen else 3 if text[-1] not in ".!?" else 0
        seen.add((role, text))
        symbols.append((role[0], fault, 1))
    edits, _ = conversations.walked(symbols, conversations.cost_to_go(symbols, conversations.END), 0, True)
    assert "".join(r["edit"] for r in turns) == "".join(x[1] for x in edits)
    assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in turns if r["edit"] != "D"))


def word_sets(text, k):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_copies():
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(300))
    base = [word() for _ in range(150)]
    out = [None, "", " \n ", "one", "One", "a b c", "A b C", "x" * 400, "w " * 900]
    for i in range(60):  # a middle with near copies about the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [" ".join(base)] * 20 + [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    out += [" ".join(f"v{i}" for i in range(40_000)), " ".join(f"v{i}" for i in range(39_000))]
    ids = list(range(len(out)))
    rnd.shuffle(ids)
    return [(i, t, "clash", 3) for i, t in zip(ids, out, strict=True)]


def test_superminhash_groups(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands string, n int").repartition(4)
    sets = {i: word_sets(t, 5) for i, t, *_ in rows}
    top = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(top)
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and sets[b] and top[a] != top[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    top[a] = top[b] = min(top[a], top[b])
        if top == before:
            break
    got = superminhash.near_duplicates(docs, 5, (85, 100)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), top[i], top[i] == i) for i, s in sets.items()}
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "g h"), (None, "i j"), (None, None)], "doc_id long, text string")
    got = sorted(repr((r.doc_id, r.component_id, r.kept)) for r in superminhash.near_duplicates(odd).collect())
    assert got == sorted(repr(x) for x in [(None, 4, False)] * 2 + [(4, 4, True)] * 2 + [(None, None, True)] * 2)


def test_superminhash_estimates():
    """Shares of equal slots are close to the Jaccard measure, closer than independent hashes are for short sets."""
    rnd = np.random.default_rng(4)
    errors = {}
    for n in (20, 400):
        est = []
        for _ in range(150):
            x = rnd.integers(0, 2**63, n + n // 4, dtype=np.uint64)
            a, b = np.sort(x[: n]), np.sort(x[n // 4 :])
            s = superminhash.signatures([a, b])
            est.append(np.mean(s[0] == s[1]) - (n - n // 4) / (n + n // 4))
        errors[n] = float(np.std(est))
        assert abs(np.mean(est)) < 0.01
    j = 0.6
    assert errors[20] < 0.8 * (j * (1 - j) / 252) ** 0.5 and errors[400] < 1.2 * (j * (1 - j) / 252) ** 0.5


def test_superminhash_batches_do_not_matter():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 5, 30, 300, 3000)]
    together = superminhash.signatures(sets)
    assert all((superminhash.signatures([s])[0] == together[i]).all() for i, s in enumerate(sets))
    slow = np.full(252, 2**64 - 1, np.uint64)
    for x in sets[3]:  # one element after the other, without early stopping
        order = list(range(252))
        for k in range(252):
            u = int(shingles.mix(np.array([(int(x) + 0x9E3779B97F4A7C15 * (k + 1)) % 2**64], np.uint64))[0])
            j = k + ((u >> 32) * (252 - k) >> 32)
            order[k], order[j] = order[j], order[k]
            slow[order[k]] = min(int(slow[order[k]]), k << 32 | u & 0xFFFFFFFF)
    assert (slow == together[3]).all()
