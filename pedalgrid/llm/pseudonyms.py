"""Personal data replaced by format-preserving Feistel pseudonyms.

E-mail addresses, IPv4 addresses, phone numbers, US social security numbers,
IBANs, payment cards and dates are found by pattern, validated (Luhn, mod 97,
calendar, number ranges) and permuted with a key inside their own format: a card
stays a card with a right check digit, a date a date. A value is a list of
numbers, each below a radix of its own; rounds add a keyed hash of one half to
the other half, so the map is a permutation for each kind and length. Equal values
get equal pseudonyms in every document, whatever separators or letter case they
are written with, and ``rewrite(..., restore=True)`` undoes them.

What fails its check (a number that is no card, 31 February) stays as it is, and so
do e-mail domains, country codes and all other text. A failed run of digits or capitals is
read again for a part that passes: a card before its code, an IBAN before a word. Dates are
those from 1800 to 2199, whose 146,097 days are 189 times 773; month first where no
day can be, and then moved on until that holds again, so these are linked with each other only.
The key has no default. Restoring a run read in parts is exact but where a part that failed
its check before passes it by chance afterwards.

Defined cases: NULL text stays NULL and counts 0; empty and very long texts are
ordinary; rows are independent, so repeated rows and empty tables need no care;
all other columns pass through.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import let, query, table

# the session setting that names the key of the query and of the pipeline's stage
KEY_SETTING = "spark.pedalgrid.pseudonyms.key"
TRIAL_KEY = "trial key of the test tables"
ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# an address has 64 characters before its @ and 127 labels of 63 after it at most; groups are bounded, as the matcher
# goes down a level with each turn of one
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\w)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d([./-])\d\d\1\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?|00\d{1,3}[ .-])?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
ANY = "|".join((EMAIL, IP, DATE, SSN, PHONE, IBAN, CARD)).replace(r"([./-])\d\d\1", r"(?<sep>[./-])\d\d\k<sep>")
N_DAYS, DAY_RADIX = 146_097, 773
# numbers of digits of a card inside a longer run of groups, most usual first
CARD_SIZES = (16, 15, 14, 13, 19, 18, 17)
# Length of an IBAN by country.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ XK LT LU",
    21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL TL AE",
    24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MR MC SM",
    28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# a walk over dates ends before this many steps but for one start in 10^16
MOST_STEPS = 64


def permuted(values: Column, radices: Column, kind: str, key: str, restore: bool) -> Column:
    """A keyed permutation of ``values`` (longs), each below its radix."""
    sign = -1 if restore else 1

    def turn(acc: Column, k: Column) -> Column:
        half = F.floor(F.size(acc) / 2).cast("int")
        first = k % 2 == 1
        rest = F.when(first, F.slice(acc, half + 1, F.size(acc))).otherwise(F.slice(acc, F.lit(1), half))

        def step(seen: Column) -> Column:
            def moved(x: Column, i: Column) -> Column:
                secret = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k, i, seen), 256)
                shift = F.conv(F.left(secret, F.lit(15)), 16, 10).cast("long")
                radix = F.get(radices, i)
                return F.when((i < half) == first, F.pmod(x + sign * (shift % radix), radix)).otherwise(x)

            return F.transform(acc, moved)

        return let(F.array_join(rest, ","), step)

    order = range(ROUNDS, 0, -1) if restore else range(1, ROUNDS + 1)
    return F.aggregate(F.array(*map(F.lit, order)), values, turn)


def permuted_text(s: Column, kind: str, key: str, restore: bool) -> Column:
    """Letters and digits of ``s`` permuted place by place within their class."""

    def start(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65)

    def of(chars: Column) -> Column:
        values = F.transform(chars, lambda c: F.coalesce(F.ascii(c) - start(c), F.lit(0)).cast("long"))
        radices = F.transform(
            chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")
        )
        return let(
            let(values, lambda v: let(radices, lambda r: permuted(v, r, kind, key, restore))),
            lambda new: F.array_join(
                F.transform(chars, lambda c, i: F.coalesce(F.char(start(c) + F.get(new, i)), c)), ""
            ),
        )

    return let(F.split(s, ""), of)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9]", "")


def refilled(layout: Column, marks: Column) -> Column:
    """``layout`` with its letters and digits replaced by ``marks`` in turn."""
    return F.array_join(
        F.transform(
            F.split(layout, ""),
            lambda c, i: F.when(
                c.rlike("[A-Za-z0-9]"), F.substr(marks, F.length(digits_of(F.left(layout, i + 1))), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )


def check_sum(digits: Column) -> Column:
    """Luhn sum of a whole card number, the last digit counted once."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def mod_97(s: Column) -> Column:
    return F.aggregate(
        F.split(s, ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def email(m: Column, key: str, restore: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permuted_text(name, "email", key, restore), F.substr(m, F.length(name) + 1))


def address(m: Column, key: str, restore: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    radix = F.array(*[F.lit(256).cast("long")] * 4)
    return F.array_join(let(parts, lambda v: permuted(v, radix, "ip", key, restore)), ".")


def date(m: Column, key: str, restore: bool) -> Column:
    year_first = m.rlike(r"^\d{4}")
    part = lambda at, n: F.substr(m, F.lit(at), F.lit(n)).cast("int")
    year = F.when(year_first, part(1, 4)).otherwise(part(7, 4))
    month = F.when(year_first, part(6, 2)).otherwise(part(4, 2))
    day = F.when(year_first, part(9, 2)).otherwise(part(1, 2))
    # 12/31/1999: no day first, so the month is
    month_first = ~year_first & m.rlike("[/-]") & (month > 12) & (day <= 12)
    month, day = F.when(month_first, day).otherwise(month), F.when(month_first, month).otherwise(day)
    start = F.lit("1800-01-01").cast("date")
    true_day = F.when(
        year.between(1800, 2199) & month.between(1, 12) & (day >= 1),
        let(F.make_date(year, month, F.lit(1)), lambda d: F.when(day <= F.day(F.last_day(d)), F.date_add(d, day - 1))),
    )
    radix = F.array(F.lit(N_DAYS // DAY_RADIX).cast("long"), F.lit(DAY_RADIX).cast("long"))

    def moved(d: Column) -> Column:
        n = F.datediff(d, start).cast("long")
        pair = F.array(F.floor(n / DAY_RADIX).cast("long"), n % DAY_RADIX)
        return let(
            let(pair, lambda v: permuted(v, radix, "date", key, restore)),
            lambda v: F.date_add(start, (F.get(v, F.lit(0)) * DAY_RADIX + F.get(v, F.lit(1))).cast("int")),
        )

    def walked(d: Column) -> Column:
        """Moved on until the day cannot be a month, so that it reads month first again:
        a permutation of such dates."""

        def on(at: Column, _: Column) -> Column:
            return F.when(at.isNotNull() & (at != d) & (F.day(at) > 12), at).otherwise(moved(F.coalesce(at, d)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), F.lit(None).cast("date"), on)

    def written(d: Column) -> Column:
        order = F.when(year_first, "yyyyMMdd").when(month_first, "MMddyyyy").otherwise("ddMMyyyy")
        return refilled(
            m,
            F.when(order == "yyyyMMdd", F.date_format(d, "yyyyMMdd"))
            .when(order == "MMddyyyy", F.date_format(d, "MMddyyyy"))
            .otherwise(F.date_format(d, "ddMMyyyy")),
        )

    return let(
        true_day,
        lambda d: F.when(d.isNotNull(), let(F.when(month_first, walked(d)).otherwise(moved(d)), written)),
    )


def social_security(m: Column, key: str, restore: bool) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("long") for i in range(3))
    # 898 areas: 001 to 899 without 666; groups 01 to 99; serials 0001 to 9999
    radix = F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)])
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    return F.when(
        area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0),
        let(
            let(values, lambda v: permuted(v, radix, "ssn", key, restore)),
            lambda v: F.format_string(
                "%03d-%02d-%04d",
                F.get(v, F.lit(0)) + F.when(F.get(v, F.lit(0)) >= 665, 2).otherwise(1),
                F.get(v, F.lit(1)) + 1,
                F.get(v, F.lit(2)) + 1,
            ),
        ),
    )


def phone(m: Column, key: str, restore: bool) -> Column:
    # a country code is kept; without a gap after it, the first digit stands for it
    country = F.regexp_extract(m, r"^(?:\+(?:\d{1,3}(?=[ .(-])|\d)|00\d{1,3}(?=[ .-]))", 0)
    rest = F.substr(m, F.length(country) + 1)
    return F.concat(country, refilled(rest, permuted_text(digits_of(rest), "phone", key, restore)))


def inside(m: Column, part: Column, new: Column) -> Column:
    """``m`` with its first ``part`` replaced."""
    at = F.instr(m, part)
    return F.concat(F.left(m, at - 1), new, F.substr(m, at + F.length(part)))


def card(m: Column, key: str, restore: bool) -> Column:
    """A run of groups of digits is no card as a whole if it ends in a code or a date;
    so a phone number in it comes first, then whole groups that pass the check, of the
    most usual size first. What is left of the run stays."""

    def moved(part: Column, all_digits: Column) -> Column:
        body = F.left(all_digits, F.length(all_digits) - 1)
        return let(
            permuted_text(body, "card", key, restore),
            lambda new: refilled(part, F.concat(new, ((10 - check_sum(F.concat(new, F.lit("0"))) % 10) % 10).cast("string"))),
        )

    def first(part: Column) -> Column:
        return F.when(part.isNotNull(), inside(m, part, let(digits_of(part), lambda d: moved(part, d))))

    # looks ahead, so that readings may overlap
    readings = F.flatten(
        F.array(*[F.regexp_extract_all(m, F.lit(rf"(?<!\d)(?=(\d(?:[ -]?\d){{{n - 1}}})(?!\d))"), F.lit(1)) for n in CARD_SIZES])
    )
    valid = F.filter(readings, lambda x: check_sum(digits_of(x)) % 10 == 0)
    called = F.regexp_extract(m, PHONE, 0)
    return F.when(called != "", let(called, lambda p: inside(m, p, phone(p, key, restore)))).otherwise(
        let(F.get(valid, F.lit(0)), first)
    )


def iban(m: Column, key: str, restore: bool) -> Column:
    """What follows in capitals (``BIC``) may look like a part: where the country's
    length is known, so much is read, if a group ends there, else the whole."""

    def moved(part: Column, s: Column) -> Column:
        country = F.left(s, F.lit(2))
        return let(
            permuted_text(F.substr(s, F.lit(5)), "iban", key, restore),
            lambda new: refilled(
                part, F.concat(country, F.lpad((98 - mod_97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)
            ),
        )

    def replaced(part: Column) -> Column:
        right = lambda s: mod_97(F.concat(F.substr(s, F.lit(5)), F.left(s, F.lit(4)))) == 1
        return let(digits_of(part), lambda s: F.when(right(s), inside(m, part, moved(part, s))))

    own = F.lit("")
    for size, countries in IBAN_SIZES.items():
        so_long = F.regexp_extract(m, rf"^[A-Z0-9](?: ?[A-Z0-9]){{{size - 1}}}(?![A-Z0-9])", 0)
        own = F.when(F.left(m, F.lit(2)).isin(countries.split()), so_long).otherwise(own)
    return let(F.coalesce(F.nullif(own, F.lit("")), m), replaced)


def pseudonym(m: Column, key: str, restore: bool) -> Column:
    """NULL where ``m`` fails its check."""

    def whole(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")

    return (
        F.when(m.contains("@"), email(m, key, restore))
        .when(whole(IP), address(m, key, restore))
        .when(whole(DATE), date(m, key, restore))
        .when(whole(SSN), social_security(m, key, restore))
        .when(whole(PHONE), phone(m, key, restore))
        .when(whole(IBAN), iban(m, key, restore))
        .otherwise(card(m, key, restore))
    )


def rewritten(text: Column, key: str, restore: bool = False) -> Column:
    """Struct of the rewritten ``text`` and ``n_pii``, how many values were replaced."""

    def rebuilt(new: Column) -> Column:
        gaps = F.split(text, ANY, -1)
        joined = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i)["to"], F.lit("")))), "")
        changed = F.size(F.filter(new, lambda x: x["changed"])).cast("long")
        return F.struct(joined.alias("text"), changed.alias("n_pii"))

    def replaced(m: Column) -> Column:
        return let(
            pseudonym(m, key, restore),
            lambda p: F.struct(F.coalesce(p, m).alias("to"), p.isNotNull().alias("changed")),
        )

    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    # most texts hold neither digit nor @ and are passed on after one quick look
    return F.when(text.rlike("[0-9@]"), let(F.transform(found, replaced), rebuilt)).otherwise(
        F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_pii"))
    )


def rewrite(docs: DataFrame, key: str, restore: bool = False) -> DataFrame:
    """``docs`` with its text rewritten; where it changed, ``n_chars`` follows."""
    made = next(n for n in ("made" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    new = {"text": F.col(made)["text"]}
    if "n_chars" in docs.columns:
        now = F.length(F.col(made)["text"]).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col(made)["n_pii"] > 0, now).otherwise(F.col("n_chars"))
    return docs.withColumn(made, rewritten(F.col("text"), key, restore)).withColumns(new).drop(made)


def session_key(spark: SparkSession) -> str:
    """The key that the session names; without one, which only suits public test
    tables, a trial key that everyone knows."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms can be undone by anyone", stacklevel=2)
    return named or TRIAL_KEY


@query("op6_pseudonyms")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", rewritten(F.col("text"), session_key(spark)).alias("r")).select("doc_id", "r.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms in place of personal data."""
    return rewrite(docs, session_key(spark))
