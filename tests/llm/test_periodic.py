import random
from hashlib import sha256
from zlib import crc32

from pedalgrid.llm import QUERIES, periodic as P


def slow_runs(words):
    """Every stretch of every period, by comparing words that lie a period apart."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            start = at
            while at + q < n and words[at] == words[at + q]:
                at += 1
            part = words[start : at + q]
            smaller = any(part[r:] == part[: len(part) - r] for r in range(1, q))
            if len(part) >= max(6, 4 * q) and not smaller:
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        len(runs),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters = rng.choice([1, 2, 3, 30])
            t = [b"w%d" % rng.randrange(letters) for _ in range(rng.randrange(90))]
            if t and rng.random() < 0.6:
                a, p = rng.randrange(len(t)), rng.randint(1, 8)
                t = t[:a] + (t[a : a + p] * 40)[: rng.randint(1, 60)] + t[a:]
            texts.append(t)
        assert P.runs_of(texts) == [slow_runs(t) for t in texts]


def test_runs_within_runs_and_copies():
    inner = [b"x"] * 7 + [b"y"]
    assert P.runs_of([inner * 5, [], inner * 5]) == [slow_runs(inner * 5), [], slow_runs(inner * 5)]
    fib = [b"a"], [b"a", b"b"]
    for _ in range(10):
        fib = fib[1], fib[1] + fib[0]
    assert P.runs_of([fib[1]]) == [slow_runs(fib[1])]


def test_long_texts():
    assert P.runs_of([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]
    # one phrase 20,000 times, each time after another word
    phrase = [w for i in range(20_000) for w in (b"q%d" % i, b"x", b"y", b"z", b"u", b"v")]
    assert P.runs_of([phrase]) == [[]]
    period = [b"p%d" % i for i in range(30_000)]
    assert P.runs_of([[b"before"] + period * 5]) == [[(1, 150_000, 30_000)]]


def test_query_rows(spark, awkward, nothing, tmp_path):
    lines = "same line here\n" * 9 + "other words " * 3
    docs = awkward.union(awkward.selectExpr("doc_id + 100", f"concat(text, '\n{lines}', text)", *awkward.columns[2:]))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    rows = [r for r in docs.select("doc_id", "text").collect()]
    short = [(r["doc_id"], *slow_row(*r)) for r in rows if len(r["text"] or "") < 5000]
    assert sorted(short, key=repr) == [r for r in got if r[0] in {s[0] for s in short}]
    assert len(got) == len(rows)
    assert P.periodic_runs(nothing).count() == 0


def test_collapsed(spark):
    docs = spark.createDataFrame([(1, "a b a b\ta b a b c", "x"), (2, None, "y")], "doc_id long, text string, runs string")
    a, b = P.periodic_runs(docs).orderBy("doc_id").collect()
    assert (a["n_words"], [tuple(r) for r in a["runs"]], a["collapsed"]) == (9, [(0, 8, 2)], "a b c")
    assert (b["n_words"], b["runs"], b["collapsed"]) == (0, [], "")


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        if len(text or "") < 6000:
            assert got[doc_id] == slow_row(doc_id, text)
