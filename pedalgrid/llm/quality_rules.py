"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words
are compared with its language's reference by Jensen-Shannon distance (base 2,
square root, 0 to 1). References are the summed histograms of all documents of
the language that are long enough. A text is counted once, inside its own row, and the
counts are written out; references and verdicts are made from them. The only shuffle
carries one row of sums per language and task.

Guards: a document under ``MIN_CHARS`` word characters has no class verdict, one
under ``MIN_WORDS`` words no word verdict, and one whose language has no
reference (NULL, unlisted, or no document long enough) no verdict at all. No
verdict keeps a document, unless the base rules reject it.

Defined cases: NULL text is the empty text (no words, base rules reject it);
repeated rows are judged each on its own; an empty table gives no rows; other
columns of the input are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle
from .registry import let, query, table

# Twenty frequent function words per language.
COMMON_WORDS = {
    "en": "the of and to in a is that for on with as by at from was are be this or",
    "fr": "de la le et les des en un une du que est pour dans qui sur au par pas avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
WORD_GAP = r"[\x20\x09-\x0D]+"
N_CLASSES = 7
MIN_CHARS = 100
MIN_WORDS = 100
MAX_CLASS_DISTANCE = 0.24
MAX_WORD_DISTANCE = 0.28
BASE_MIN_WORDS = 50
BASE_MAX_REPEATED = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda x: x != "")


def class_counts(text: Column) -> Column:
    """Characters by class: a-z, blank, A-Z, other letters, digits, sentence
    marks, anything else. Each pass works on what the one before left over."""

    def without(t: Column, pattern: str) -> Column:
        return F.regexp_replace(t, pattern, "")

    def last(n0, n1, n2, n3, t3):
        return let(
            without(t3, r"\p{L}+"),
            lambda t4: let(
                without(t4, r"\p{N}+"),
                lambda t5: let(
                    F.length(without(t5, r"[.,;:?'\"()-]+")),
                    lambda n6: F.array(
                        n0 - n1,
                        n1 - n2,
                        n2 - n3,
                        n3 - F.length(t4),
                        F.length(t4) - F.length(t5),
                        F.length(t5) - n6,
                        n6,
                    ),
                ),
            ),
        )

    return let(
        without(text, "[a-z]+"),
        lambda t1: let(
            without(t1, WORD_GAP),
            lambda t2: let(
                without(t2, "[A-Z]+"),
                lambda t3: last(F.length(text), F.length(t1), F.length(t2), F.length(t3), t3),
            ),
        ),
    )


def word_counts(words: Column, lang: Column) -> Column:
    """How often each common word of ``lang`` occurs, then all other words."""
    known = F.lit(None).cast("array<string>")
    for code, listed in COMMON_WORDS.items():
        known = F.when(lang == code, F.array(*map(F.lit, listed.split()))).otherwise(known)
    every = sorted({w for listed in COMMON_WORDS.values() for w in listed.split()})

    def counted(common: Column) -> Column:
        each = F.transform(known, lambda k: F.size(common) - F.size(F.array_remove(common, k)))
        return let(
            each,
            lambda n: F.concat(
                n, F.array(F.size(words) - F.aggregate(n, F.lit(0), lambda a, x: a + x))
            ),
        )

    return let(F.filter(F.transform(words, F.lower), lambda x: x.isin(*every)), counted)


FEW_REPEATS = 64


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three found at least twice in the text.

    Windows are compared by hash. Most texts repeat none, and are done after one look
    for doubles. Else the places of repeated windows are found, and sorted places
    give the covered length: through the list of repeated hashes if it is short, else
    by sorting all windows beside their places, so that no text costs more than a sort.
    """

    def some(h: Column) -> Column:
        def places(doubles: Column) -> Column:
            each = F.sequence(F.lit(0), F.size(h) - 1)
            few = F.filter(each, lambda i: F.array_contains(doubles, F.get(h, i)))
            return F.when(F.size(doubles) <= FEW_REPEATS, few).otherwise(many(h))

        ranks = F.sequence(F.lit(1), F.size(h) - 1)
        twice = lambda s: F.filter(ranks, lambda i: F.get(s, i) == F.get(s, i - 1))
        doubles = let(F.sort_array(h), lambda s: F.array_distinct(F.transform(twice(s), lambda i: F.get(s, i))))
        return let(let(doubles, places), covered)

    def many(h: Column) -> Column:
        def marked(g: Column) -> Column:
            here = F.sequence(F.lit(0), F.size(g) - 1)
            twice = F.filter(
                here,
                lambda i: ((i > 0) & (F.get(g, i - 1)["h"] == F.get(g, i)["h"]))
                | ((i < F.size(g) - 1) & (F.get(g, i + 1)["h"] == F.get(g, i)["h"])),
            )
            return F.array_sort(F.transform(twice, lambda i: F.get(g, i)["i"]))

        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return let(F.array_sort(placed), marked)

    def covered(at: Column) -> Column:
        after = F.slice(at, 2, F.greatest(F.size(at), F.lit(1)))
        reach = F.zip_with(at, after, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(
        F.size(words) >= 4,
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(some(h))),
    ).otherwise(0)


def duplicate_lines(text: Column) -> Column:
    said = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(said, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram to a reference of shares."""
    ref = F.array(*[F.lit(float(x)) for x in reference])

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        return F.when(p > 0, p / 2 * F.log2(p / m)).otherwise(0.0) + F.when(
            q > 0, q / 2 * F.log2(q / m)
        ).otherwise(0.0)

    def of(total: Column) -> Column:
        parts = F.zip_with(counts, ref, lambda c, q: part(c / total, q))
        return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))

    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return let(total, lambda n: F.when(n > 0, of(n)))


def counts(text: Column, lang: Column) -> Column:
    """Struct of all that is counted in a text: ``n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words``, the histograms ``classes`` and ``common`` (NULL for a
    language without a list)."""
    body = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            duplicate_lines(body).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            class_counts(body).alias("classes"),
            word_counts(w, lang).alias("common"),
        )

    return let(words_of(body), of)


References = dict[str, tuple[list[float], list[float]]]


def fit(counted: DataFrame, lang: str, made: str) -> References:
    """Per listed language the shares of character classes and common words
    over all its documents of at least ``MIN_WORDS`` words."""
    n_bins = {code: len(listed.split()) + 1 for code, listed in COMMON_WORDS.items()}
    n = F.col(made)
    long = counted.where(F.col(lang).isin(*COMMON_WORDS) & (n["n_words"] >= MIN_WORDS))
    sums = [F.sum(F.get(n["classes"], F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)]
    sums += [F.sum(F.get(n["common"], F.lit(i))).alias(f"w{i}") for i in range(max(n_bins.values()))]
    shares = {}
    for r in long.groupBy(F.col(lang).alias("_lang")).agg(*sums).collect():  # a row per listed language
        c = [r[f"c{i}"] for i in range(N_CLASSES)]
        w = [r[f"w{i}"] for i in range(n_bins[r["_lang"]])]
        shares[r["_lang"]] = ([x / sum(c) for x in c], [x / sum(w) for x in w])
    return shares


def verdict(n: Column, lang: Column, references: References) -> Column:
    """Struct of the counts, the distances and the verdicts, from a struct of counts."""

    def by_language(histogram: Column, which: int) -> Column:
        far = F.lit(None).cast("double")
        for code, shares in sorted(references.items()):
            far = F.when(lang == code, distance(histogram, shares[which])).otherwise(far)
        return far

    failed = (n["n_words"] < BASE_MIN_WORDS) | (100 * n["n_repeat_words"] > BASE_MAX_REPEATED * n["n_words"])
    far = F.struct(
        F.when(n["word_chars"] >= MIN_CHARS, by_language(n["classes"], 0)).alias("c"),
        F.when(n["n_words"] >= MIN_WORDS, by_language(n["common"], 1)).alias("w"),
    )
    return let(
        far,
        lambda d: F.struct(
            *[n[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"),
            (
                ~failed
                & (F.coalesce(d["c"], F.lit(0.0)) <= MAX_CLASS_DISTANCE)
                & (F.coalesce(d["w"], F.lit(0.0)) <= MAX_WORD_DISTANCE)
            ).alias("kept"),
            F.round(d["c"], 4).alias("class_distance"),
            F.round(d["w"], 4).alias("word_distance"),
        ),
    )


def judge(docs: DataFrame, references: References | None = None) -> tuple[DataFrame, Column]:
    """``docs`` with their counts, written out so that each text is read once, and the
    verdict on them. The column of counts has a name that ``docs`` does not use."""
    made = next(n for n in ("made" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    counted = settle(docs.withColumn(made, counts(F.col("text"), F.col("lang"))))
    shares = fit(counted, "lang", made) if references is None else references
    return counted, verdict(F.col(made), F.col("lang"), shares)


def _sql() -> str:
    """The same in SQL; word windows are compared as text, not by hash."""
    listed = " ".join(
        f"WHEN '{code}' THEN [" + ", ".join(f"'{w}'" for w in words.split()) + "]" for code, words in COMMON_WORDS.items()
    )
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"
    most = max(len(words.split()) for words in COMMON_WORDS.values()) + 1

    def jsd(counts: str, ref: str) -> str:
        p, m = f"z[1] / list_sum({counts})", f"((z[1] / list_sum({counts}) + z[2]) / 2)"
        part = f"(CASE WHEN z[1] > 0 THEN {p} / 2 * log2({p} / {m}) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] / 2 * log2(z[2] / {m}) ELSE 0 END)"
        return f"sqrt(greatest(list_sum(list_transform(list_zip({counts}, {ref}), lambda z: {part})), 0))"

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r1 AS (SELECT *, regexp_replace(t, '[a-z]+', '', 'g') AS t1 FROM d),
r2 AS (SELECT *, regexp_replace(t1, '[\x20\x09-\x0D]+', '', 'g') AS t2 FROM r1),
r3 AS (SELECT *, regexp_replace(t2, '[A-Z]+', '', 'g') AS t3 FROM r2),
r4 AS (SELECT *, regexp_replace(t3, '\p{{L}}+', '', 'g') AS t4 FROM r3),
r5 AS (SELECT *, regexp_replace(t4, '\p{{N}}+', '', 'g') AS t5 FROM r4),
r6 AS (SELECT *, regexp_replace(t5, '[.,;:?''"()-]+', '', 'g') AS t6, CASE lang {listed} END AS known FROM r5),
n AS (SELECT doc_id, lang, t, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
        [length(t) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5) - length(t6), length(t6)]::DOUBLE[] AS c,
        list_transform(known, lambda k: len(list_filter(w, lambda x: lower(x) = k)))::DOUBLE[] AS kw FROM r6),
h AS (SELECT *, CASE WHEN kw IS NOT NULL THEN list_append(kw, n_words - list_sum(kw)) END AS kc FROM n),
ref AS (SELECT lang, {sums('c', N_CLASSES)} AS rc, {sums('kc', most)} AS rk FROM h WHERE kc IS NOT NULL AND n_words >= {MIN_WORDS} GROUP BY 1),
q AS (SELECT lang, list_transform(rc, lambda x: x / list_sum(rc)) AS rc, list_transform(rk, lambda x: x / list_sum(rk)) AS rk FROM ref),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM g WHERE c > 1) GROUP BY 1),
v AS (SELECT h.doc_id, n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS said, coalesce(rep.n, 0) AS n_repeat_words,
        CASE WHEN word_chars >= {MIN_CHARS} AND q.lang IS NOT NULL THEN {jsd('c', 'q.rc')} END AS far_c,
        CASE WHEN n_words >= {MIN_WORDS} AND q.lang IS NOT NULL THEN {jsd('kc', 'q.rk')} END AS far_w
      FROM h LEFT JOIN q ON q.lang = h.lang LEFT JOIN rep ON rep.doc_id = h.doc_id)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, CAST(len(said) - len(list_distinct(said)) AS BIGINT) AS n_dup_lines, n_repeat_words,
       n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEATED} * n_words)
         AND coalesce(far_c, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(far_w, 0) <= {MAX_WORD_DISTANCE} AS kept,
       round(far_c, 4) AS class_distance, round(far_w, 4) AS word_distance FROM v"""


@query("op10_quality_rules", _sql())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # the text itself is not written again
    numbers = docs.select("doc_id", "lang", counts(F.col("text"), F.col("lang")).alias("n"))
    counted = settle(numbers)
    return counted.select("doc_id", verdict(F.col("n"), F.col("lang"), fit(counted, "lang", "n")).alias("r")).select("doc_id", "r.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, unchanged."""
    counted, rules = judge(docs)
    return counted.where(rules["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
