"""Quality scores by a regularised quadratic discriminant.

A document becomes ``len(NAMES)`` transformed statistics of its whole text (logs of
sizes, square roots of shares). Per class the mean and covariance come from sums of
products that Spark adds up, one row per class; on the driver the covariance is shrunk
towards the pooled one (``POOLED``) and then towards a multiple of the identity
(``ROUND``), and its Cholesky factor is kept. Classes of few rows are shrunk more: a class
of under twice as many rows as statistics keeps less of its own covariance, and the pooled
one, where both have so few, gives way to the variances of all rows, drawn to their mean;
one row a class is enough. A score is the posterior of class 1 from the
difference of the two log densities, each a Mahalanobis distance found by multiplying
with the inverse of the kept factor, and the log prior. A text far from both classes is
not scored by the tails of two Gaussians: distances are cut at ``FAR``.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0. All of
them are used; no row, text or sum is sampled.

Defined cases: NULL text is the empty text, which has statistics and a score as any
other; NULL doc_ids count as the empty text when folds are made (held out) and are never
learned from; several labels of one document count by their mean, half being 1; fewer
than two classes to learn from: every score is the share of class 1 (0.5 without any
label); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle
from .registry import query, table

NAMES = (
    "words word_length upper digit stop loud symbol other distinct top_word same_next "
    "repeated_lines line_length entropy short_words word_spread bare_words"
).split()
POOLED = 0.5
ROUND = 0.05
FAR = 60.0
THRESHOLD = 0.3
_CLASS = np.zeros((256, 7))
for _k, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"#*$%&|<>", bytes(range(128, 256)), b" \t\n\r\x0b\x0c")
):
    _CLASS[list(_bytes), _k] = 1


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``NAMES``."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n = max(len(words), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256)
    shares = counts / max(len(data), 1)
    upper, digit, stop, loud, symbol, other, _ = np.sqrt(shares @ _CLASS)
    seen = shares[shares > 0]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    kinds = Counter(words)
    return [
        np.log1p(len(words)),
        np.log1p(sizes.sum() / n),
        upper,
        digit,
        stop,
        loud,
        symbol,
        other,
        np.log1p(len(kinds)) - np.log1p(len(words)),
        np.sqrt(max(kinds.values(), default=0) / n),
        np.sqrt(sum(map(bytes.__eq__, words, words[1:])) / n),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        np.log1p(len(data) / max(len(lines), 1)),
        float(-(seen * np.log2(seen)).sum()),
        np.sqrt((sizes <= 3).sum() / n),
        np.log1p(sizes.std()) if len(words) else 0.0,
        np.sqrt(sum(map(bytes.isalpha, words)) / n),
    ]


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out`` and the statistics ``s0, s1, ...``, written out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t.as_py()) for t in batch["text"]], float).reshape(-1, len(NAMES))
            columns = [batch["doc_id"], *(pa.array(c) for c in made.T)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"s{i}" for i in range(len(NAMES)))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"s{i} double" for i in range(len(NAMES)))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return settle(docs.select("doc_id", "text").mapInArrow(of, schema).withColumn("held_out", fold == 0))


class Discriminant:
    """Two Gaussians with shrunk covariances; factors are made once and kept."""

    def __init__(self, n: list[float], sums: list[np.ndarray], products: list[np.ndarray]):
        total = sum(n)
        self.prior = (n[1] / total) if total else 0.5
        self.known = min(n) >= 1
        if not self.known:
            return
        means = [s / k for s, k in zip(sums, n)]
        spread = [p / k - np.outer(m, m) for p, k, m in zip(products, n, means)]
        pooled = (n[0] * spread[0] + n[1] * spread[1]) / total
        middle = sum(sums) / total
        spans = np.maximum(sum(map(np.diag, products)) / total - middle**2, 0)
        trust = self.trust(total - 2)
        # few rows may agree in a statistic by chance, so each variance is drawn to their mean
        pooled = trust * pooled + (1 - trust) * np.diag((spans + spans.mean()) / 2)
        # statistics are put on one scale before a covariance is rounded off
        self.scale = 1 / np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        pooled = pooled * np.outer(self.scale, self.scale)
        self.means, self.inverse, self.log_size = [], [], []
        for k, m, s in zip(n, means, spread):
            own = (1 - POOLED) * self.trust(k - 1)
            c = own * s * np.outer(self.scale, self.scale) + (1 - own) * pooled
            c = (1 - ROUND) * c + ROUND * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            self.means.append(m)
            self.inverse.append(np.linalg.inv(factor))
            self.log_size.append(np.log(np.diag(factor)).sum())

    @staticmethod
    def trust(free: float) -> float:
        """Part of a covariance with that many degrees of freedom that is kept."""
        return min(1.0, free / (2 * len(NAMES)))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.prior)
        log = []
        for m, inverse, size in zip(self.means, self.inverse, self.log_size):
            z = ((x - m) * self.scale) @ inverse.T
            log.append(-0.5 * np.square(z).sum(1) - size)
        odds = np.clip(log[1] - log[0], -FAR, FAR) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-odds))


def fit(described_: DataFrame, labels: DataFrame) -> Discriminant:
    """The discriminant of the labelled rows that are not held out."""
    p = len(NAMES)
    one = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("label")
    )
    rows = described_.where(~F.col("held_out")).join(one, "doc_id")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(f"s{i}").alias(f"a{i}") for i in range(p))]
    sums += [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"b{i}_{j}") for i, j in pairs]
    n, first, second = [0.0, 0.0], [np.zeros(p)] * 2, [np.zeros((p, p))] * 2
    for r in rows.groupBy("label").agg(*sums).collect():  # a row per class
        k = r["label"]
        n[k] = r["n"]
        first[k] = np.array([r[f"a{i}"] for i in range(p)])
        m = np.zeros((p, p))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"b{i}_{j}"]
        second[k] = m
    return Discriminant(n, first, second)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = described(docs)
    model = fit(rows, labels)
    stats = [f"s{i}" for i in range(len(NAMES))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch[c].to_numpy() for c in stats])
            s = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", *stats).mapInArrow(
        of, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


@query("op1_quality_discriminant")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return scored(table(spark, sf_dir, "documents"), labels)
