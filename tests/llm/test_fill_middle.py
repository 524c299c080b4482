import random
import re
from hashlib import sha256

from pyspark.sql import functions as F

from pedalgrid.llm import QUERIES, fill_middle as M


def slow_row(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    head, middle, tail = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return len(units), "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


def odd_texts():
    rng = random.Random(3)
    letters = ["a", "é", "語", "😀", "\n", "\n", "\r", "<", "S", ">", " ", " "]
    for n in (0, 1, 2, 3, 7, 40, 400, 3000):
        for _ in range(30):
            yield "".join(rng.choice(letters) for _ in range(n))
    yield from ("\n", "\n\n", "x", "x\n", "a<P>b\nc", "<S>", "<M>\n", "<<S", "a\n" * 5000, "語" * 4000 + "\n" + "é" * 999)


def test_transformed_by_regex():
    for doc_id, text in enumerate(odd_texts()):
        n, form, before, middle, out = M.transformed(doc_id, text.encode())
        assert (n, form, before, middle, out.decode()) == slow_row(doc_id, text)


def test_every_cut():
    for text in ("", "a\nbb\n\nccc", "é\n" * 50 + "語", "x" * 100 + "\n" + "y" * 100):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        for block in (1, 3, 16, 1024):
            lines = M.Lines(text.encode(), block)
            assert lines.n == len(units)
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert lines.cut(k) == (len(head.encode()), len(head))


def test_query_rows(spark, awkward, nothing):
    texts = list(odd_texts())
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text", "made", "key").unionByName(made, allowMissingColumns=True)
    docs = docs.withColumns({"output": F.lit(1), "form": F.lit("psm"), "n": F.lit("n")})
    rows = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *slow_row(*r)) for r in rows), key=repr)
    got = M.fill_in_middle(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    again = got.select("doc_id", M.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in rows), key=repr)
    assert M.fill_in_middle(nothing).count() == 0


def test_rates(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'one\ntwo\nthree' AS text")
    forms = M.fill_in_middle(docs, seed=1, rate=30, spm=20).groupBy("form").count().collect()
    n = {r["form"]: r["count"] for r in forms}
    assert abs(n["plain"] - 1400) < 120 and abs(n["spm"] - 120) < 50 and sum(n.values()) == 2000


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op12_fill_in_middle"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        n, form, before, middle, out = slow_row(r["doc_id"], r["text"])
        g = got.pop(r["doc_id"])
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"]) == (n, form, before, middle)
        assert g["output_sha256"] == sha256(out.encode()).hexdigest()
        assert g["restored_sha256"] == sha256((r["text"] or "").encode()).hexdigest()
    assert not got
