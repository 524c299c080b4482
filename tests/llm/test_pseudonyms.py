import datetime
import re

import pytest
from pyspark.sql import functions as F

from pedalgrid.llm import pseudonyms as P

from .conftest import as_docs


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


FORMATS = {
    "Ann.Lee-07@mail.example.com": r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}-\d\d@mail\.example\.com",
    "192.168.7.31": r"\d{1,3}(\.\d{1,3}){3}",
    "+1 (124) 555-4766": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "(124) 555-4766": r"\(\d{3}\) \d{3}-\d{4}",
    "+4915112345678": r"\+\d{13}",
    "4041894974608795": r"\d{16}",
    "4041-8949-7460-8795": r"\d{4}-\d{4}-\d{4}-\d{4}",
    "DE89 3704 0044 0532 0130 00": r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d",
    "123-45-6789": r"\d{3}-\d\d-\d{4}",
    "2024-02-29": r"\d{4}-\d\d-\d\d",
    "31.12.1999": r"\d\d\.\d\d\.\d{4}",
    "2001/07/04": r"\d{4}/\d\d/\d\d",
}
PLAIN = [
    "4041894974608796",  # fails Luhn
    "2023-02-29", "31.11.1999", "0000-00-00",
    "DE88 3704 0044 0532 0130 00",
    "000-12-3456", "666-12-3456",
    "999.1.2.3", "1.2.3", "4.0.", "version 3.14", "2,500", "a@b", "no data",
    "token = \"027aea05eb92c454086e6575cd38d76a884acaff\"",
]


def run(spark, texts, key="a key", **kw):
    rows = as_docs(spark, texts).select("doc_id", P.rewritten(F.col("text"), key, **kw).alias("r")).select("doc_id", "r.*").collect()
    return [(r["text"], r["n_pii"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_formats_are_kept(spark):
    texts = [f"see {x}, and {x}." for x in FORMATS] + [f"see {x} there" for x in PLAIN]
    out = run(spark, texts)
    for (old, shape), (new, n) in zip(FORMATS.items(), out):
        assert n == 2 and old not in new, (old, new)
        one, two = re.fullmatch(r"see (.*), and (.*)\.", new).groups()
        assert one == two and re.fullmatch(shape, one), (old, new)
        if shape == r"\d{16}" or old.startswith("4041-"):
            assert luhn(one)
        if old.startswith("DE"):
            assert iban_ok(one)
    for x, (new, n) in zip(PLAIN, out[len(FORMATS):]):
        assert (new, n) == (f"see {x} there", 0)


def test_dates_stay_dates(spark):
    days = [datetime.date(1800, 1, 1) + datetime.timedelta(days=977 * k) for k in range(149)] + [datetime.date(2199, 12, 31)]
    out = [x for x, _ in run(spark, [d.isoformat() for d in days])]
    assert len({datetime.date.fromisoformat(x) for x in out}) == len(days)


def test_equal_values_stay_linked_and_a_key_restores_them(spark):
    texts = [
        "a 4041894974608795 b 4041 8949 7460 8795 c",
        "Bob.7@x.com bob.7@x.com",
        " ".join(FORMATS) + " x",
        "", " ", "x" * 200_000 + " 123-45-6789",
    ]
    out = [x for x, _ in run(spark, texts)]
    a, b = re.findall(r"\d{16}|(?:\d{4} ){3}\d{4}", out[0])
    assert a == b.replace(" ", "")
    a, b = out[1].split()
    assert a.lower() == b.lower()
    assert [x for x, _ in run(spark, out, restore=True)] == texts
    assert run(spark, texts, key="other")[2] != out[2]


def test_the_permutation_is_one(spark):
    pair = F.array((F.col("id") / 7).cast("long"), F.col("id") % 7)
    radix = F.array(F.lit(5).cast("long"), F.lit(7).cast("long"))
    new = spark.range(35).select(P.permuted(pair, radix, "k", "s", False).alias("v"))
    rows = {tuple(r["v"]) for r in new.collect()}
    assert rows == {(a, b) for a in range(5) for b in range(7)}


def test_stage(spark, awkward, nothing):
    out = P.stage(spark, awkward, "")
    assert out.columns == awkward.columns and out.schema == awkward.schema
    assert sorted(map(str, out.collect())) == sorted(map(str, awkward.collect()))
    assert P.stage(spark, nothing, "").count() == 0
    r = P.stage(spark, as_docs(spark, ["mail a.b@c.org"]), "").first()
    assert r["n_chars"] == len(r["text"])


PARTS = {
    "4111 1111 1111 1111 123": r"\d{4} \d{4} \d{4} \d{4} 123",
    "4111111111111111 12/26": r"\d{16} 12/26",
    "378282246310005 1234": r"\d{15} 1234",
    "BE68 5390 0754 7034 BIC": r"BE\d\d \d{4} \d{4} \d{4} BIC",
    "001-555-123-4567": r"001-\d{3}-\d{3}-\d{4}",
    "123 555-123-4567": r"123 \d{3}-\d{3}-\d{4}",
    "12/31/1999": r"(0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/\d{4}",
    "07/25/1984": r"(0[1-9]|1[0-2])/(1[3-9]|2\d|3[01])/\d{4}",
}


def test_valid_parts_of_failed_readings(spark):
    texts = [f"see {x}, and {x}." for x in PARTS]
    out = run(spark, texts)
    for (old, shape), (new, n) in zip(PARTS.items(), out):
        one, two = re.fullmatch(r"see (.*), and (.*)\.", new).groups()
        assert n == 2 and one == two and re.fullmatch(shape, one) and one != old, (old, new)
    assert luhn(out[0][0][4:23]) and luhn(out[1][0][4:20]) and iban_ok(re.search(r"BE[\d ]{17}", out[3][0]).group())
    assert [x for x, _ in run(spark, [x for x, _ in out], restore=True)] == texts
    card = run(spark, ["4111 1111 1111 1111"])[0][0]
    assert out[0][0].startswith(f"see {card} 123") and out[1][0].startswith(f"see {card.replace(' ', '')} 12")


def test_month_first_dates_are_permuted(spark):
    days = [datetime.date(1950, 1, 13) + datetime.timedelta(days=k) for k in range(400)]
    texts = [d.strftime("%m/%d/%Y") for d in days if d.day > 12]
    out = [x for x, _ in run(spark, texts)]
    assert len(set(out)) == len(texts) and all(datetime.datetime.strptime(x, "%m/%d/%Y").day > 12 for x in out)
    assert [x for x, _ in run(spark, out, restore=True)] == texts


def test_long_runs(spark):
    """A matcher that goes down a level per turn would end the executor here."""
    n = 300_000
    texts = ["." * n, "1" * n, "@" * n, "-" * n, "x@" + "a." * (n // 2) + "com", "1 " * (n // 2), "A1 " * (n // 3),
             "a" * n + "@x.org", "x@" + "a" * n + ".org", "+1 " * (n // 3), "1." * (n // 2)]
    assert all(len(new) == len(old) for old, (new, _) in zip(texts, run(spark, texts)))
    assert run(spark, ["x@" + "a." * 100 + "com"])[0][1] == 1


def test_the_key_is_wanted(spark):
    with pytest.raises(TypeError):
        P.rewritten(F.col("text"))
    with pytest.warns(UserWarning):
        assert P.session_key(spark) == P.TRIAL_KEY
    spark.conf.set(P.KEY_SETTING, "own")
    try:
        assert P.session_key(spark) == "own"
    finally:
        spark.conf.unset(P.KEY_SETTING)
