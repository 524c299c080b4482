import random
import zlib

import numpy as np
import pytest

from pedalgrid.llm import packing as K, repair as R
from pedalgrid.llm.tokens import Encoder, vocabulary_path

from .conftest import as_docs

ODD = ["", " ", "a  b", "a \n b", "\ta b", "it's <|endoftext|> ok", "a\nb", "\n\n", "x ", "don't é　 q", "a\x1cb c", "1 2\n3", "a\t \tb", "日本 語\n語"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path())


def whole(encoder, text):
    ids = encoder.whole(text or "")
    return np.append(np.frombuffer(ids, np.uint16), 2).astype("<u4")


def test_pieces_equal_whole_texts(encoder):
    rnd = random.Random(2)
    parts = ["the", "of", " ", "  ", "\n", "é", "x1", "!!", "don't", "\t", "語", ".", "ß,", "ǅ", "ªº", "İ", "'s", "²", "\u0301", "🙂", "\x00", "\u200b"]
    for t in ODD + ["".join(rnd.choice(parts) for _ in range(30)) for _ in range(400)] + [
        " ".join(rnd.choice(parts[:2] + parts[5:]) + rnd.choice(["", ".", ",", "?!", "'re"]) for _ in range(12)) for _ in range(2000)
    ]:
        assert encoder.encode(t) == encoder.whole(t), repr(t)


def test_repair_round_trip():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 5), (2, 1), (500, 1), (20_000, 3), (50_000, 300)):
        seq = rng.integers(0, kinds, n).astype(np.uint16)
        seq[rng.random(n) < 0.01] = R.LAST
        seq[-1] = R.LAST
        symbols, pairs = R.compress(seq)
        lengths = R.rule_lengths(pairs)
        assert np.array_equal(R.expand(symbols[symbols != R.LAST], pairs, lengths), seq[seq != R.LAST])
        assert (symbols == R.LAST).sum() == (seq == R.LAST).sum()
        assert len(symbols) < 0.7 * n or n < 500 or kinds == 300


def by_hand(seq):
    """How often each pair can be replaced, from left to right, one document at a time."""
    count = {}
    for pair in set(zip(seq, seq[1:])):
        at = n = 0
        while at < len(seq) - 1:
            hit = (seq[at], seq[at + 1]) == pair
            n += hit
            at += 1 + hit
        if R.LAST not in pair and n > 1:
            count[pair[0] << 16 | pair[1]] = n
    return count


def test_repair_counts_pairs_exactly_and_goes_on_to_the_end(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(R, "SLOTS", 3)  # crowded places must not lose a pair
    for n, kinds in ((0, 1), (1, 1), (40, 1), (60, 2), (300, 4), (2000, 12)):
        seq = rng.integers(0, kinds, n).astype(np.uint16)
        seq[rng.random(n) < 0.05] = R.LAST
        pair = (seq[:-1].astype(np.uint32) << 16) | seq[1:]
        assert dict(zip(*(x.tolist() for x in R.repeated(pair)))) == by_hand(seq.tolist())
        symbols, pairs = R.compress(seq)
        assert by_hand(symbols.tolist()) == {}, "a pair still repeats though symbols are left"
        lengths = R.rule_lengths(pairs)
        assert np.array_equal(R.expand(symbols[symbols != R.LAST], pairs, lengths), seq[seq != R.LAST])


def test_one_doc_id_with_most_rows(spark, encoder):
    texts = [None, *(f"row {i} " * 20 for i in range(400)), "same", "same"]
    docs = spark.createDataFrame([(None if i % 3 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    files = R.encode_files(docs)
    assert files.count() > 1
    rows = sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(R.read_files(files).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["ids_crc32"]) for r in got] == [(d, zlib.crc32(whole(encoder, t).tobytes())) for d, t in rows]


def test_files(spark, encoder, awkward, nothing, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_IDS", 3000)
    docs = awkward.unionByName(as_docs(spark, {100 + i: t for i, t in enumerate(ODD)}))
    files = R.encode_files(docs)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for d, t in rows:
        ids = whole(encoder, t)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in R.read_files(files).collect()), key=lambda r: r[1])
    assert got == want
    blocks = files.collect()
    assert len(blocks) > 1
    row = next(b for b in blocks if 103 in b["doc_ids"]).asDict()
    assert np.array_equal(R.decode(row, row["doc_ids"].index(103)), whole(encoder, ODD[3]))
    assert R.read_files(R.encode_files(nothing)).count() == 0


def check_packed(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_packing(spark, encoder, awkward, nothing):
    rows = K.pack(awkward).collect()
    check_packed(rows, 1024)
    texts = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] not in (0, 3, 6, None)}
    for d, t in texts.items():
        ids = whole(encoder, t)
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:])
        assert b"".join(ids[r["start"] : r["start"] + r["length"]].tobytes() for r in own) == ids.tobytes()
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own)
    assert K.pack(nothing).count() == 0


def test_plans_use_every_piece_once_and_few_sequences():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 400, 30_000):
        lengths = np.minimum(rng.lognormal(5.5, 1, n).astype(int) + 1, 1024)
        counts = np.bincount(lengths, minlength=1025)
        made, bound = K.plan(counts)
        used = np.zeros(1025, int)
        for config, times in made:
            assert sum(config) <= 1024
            for x in config:
                used[x] += times
        assert np.array_equal(used, counts)
        total, least = sum(t for _, t in made), -(-int(lengths.sum()) // 1024)
        assert least <= bound <= total
        assert total <= least * 1.002 + 1 and total <= sum(t for _, t in K.best_fit(counts, 1024))


def test_configuration_is_the_best(monkeypatch):
    rng = np.random.default_rng(0)
    worth = np.where(rng.random(13) < 0.6, rng.random(13), 0.0)
    worth[0] = 0

    def brute(room):
        return max([worth[n] + brute(room - n) for n in range(1, room + 1)], default=0.0)

    assert worth[K.best_configuration(worth, 12)].sum() == pytest.approx(brute(12))


def test_prices_prove_what_tokens_cannot():
    """Pieces over half or a third of a sequence: the number of tokens is a weak bound."""
    rng = np.random.default_rng(5)
    for lengths, least in ((np.full(900, 600), 900), (np.repeat([520, 400, 350, 300], 500), None), (rng.integers(342, 352, 3000), 1500)):
        counts = np.bincount(lengths, minlength=1025)
        made, bound = K.plan(counts)
        total = sum(t for _, t in made)
        assert lengths.sum() / 1024 < bound <= total
        assert total == least if least else bound >= total * 0.98


def test_no_packing_is_below_the_bound():
    """Every packing of a few short pieces, by hand."""
    rng = np.random.default_rng(6)

    def fewest(left, rooms):
        if not left:
            return len(rooms)
        n, rest = left[0], left[1:]
        tries = [rooms[:i] + (r - n,) + rooms[i + 1 :] for i, r in enumerate(rooms) if r >= n and r not in rooms[:i]]
        return min(fewest(rest, t) for t in [*tries, (*rooms, 12 - n)])

    for _ in range(12):
        lengths = rng.integers(1, 13, 7)
        made, bound = K.plan(np.bincount(lengths, minlength=13), 12)
        assert bound <= fewest(tuple(sorted(lengths.tolist(), reverse=True)), ()) <= sum(t for _, t in made)


def test_prices_pack_better_than_best_fit():
    lengths = np.random.default_rng(7).choice(np.arange(250, 520, 9), 6000)
    counts = np.bincount(lengths, minlength=1025)
    assert sum(t for _, t in K.plan(counts)[0]) < sum(t for _, t in K.best_fit(counts, 1024)) * 0.97
