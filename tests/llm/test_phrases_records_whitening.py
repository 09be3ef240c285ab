"""Operators 11 to 13 against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from railspark.llm import phrases, records, whitening
from railspark.llm.entry import WORDS


def brute_phrases(rows, least=10, top=2000):
    counts, n = {1: Counter(), 2: Counter(), 3: Counter()}, Counter()
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang or "und"] += len(words)
            for m in counts:
                for k in range(len(words) - m + 1):
                    counts[m][(lang or "und", *words[k:k + m])] += 1
    f = lambda lang, w: counts[len(w)][(lang, *w)]
    out = {}
    for m in (2, 3):
        for (lang, *w), a in counts[m].items():
            if a < least:
                continue
            if m == 2 and any(100 * b >= 50 * a for (g, *t), b in counts[3].items() if b >= least and g == lang and (t[:2] == w or t[1:] == w)):
                continue
            cuts = [(1000000 * a * a // (f(lang, w[:k]) * f(lang, w[k:])), k) for k in range(1, m)]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f(lang, w[:k]), f(lang, w[k:])))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def prose():
    rnd = random.Random(11)
    words = ["a", "b", "B", "the", "é", "É", "of", "new", "york", "x y", "it's"]
    rows = []
    for k in range(300):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "?"]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice(["en", "de", None]), text))
    rows += [("en", "New York City. new york city"), ("en", None), ("fr", ""), ("fr", " ,.! "), ("hot", "same same " * 5000), ("hot", "long" * 20000)]
    return rows + rows[:40]


@pytest.mark.parametrize("chunk,whole", [(1 << 21, 1 << 20), (50, 40), (200, 6)])
def test_phrases_against_counts(spark, prose, chunk, whole):
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in prose], "lang string, text string, n long, w1 string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(df, top=25, chunk=chunk, whole=whole).collect()))
    assert got == brute_phrases(prose, top=25) and len(got) > 30


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_rows_of_large_numbers_sort_without_packing():
    a, b, c = np.array([1 << 40, 5, 1 << 40]), np.array([1 << 40, 0, 1 << 40]), np.array([7, 7, 7])
    assert [x.tolist() for x in phrases.summed(a, b, c, np.array([1, 2, 4]))] == [[5, 1 << 40], [0, 1 << 40], [7, 7], [2, 5]]


def plain_crc(data):
    """Masked CRC-32C bit by bit."""
    r = 0xFFFFFFFF
    for byte in data:
        r ^= byte
        for _ in range(8):
            r = (r >> 1) ^ (0x82F63B78 if r & 1 else 0)
    r ^= 0xFFFFFFFF
    return ((r >> 15 | r << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    rnd = random.Random(1)
    parts = [rnd.randbytes(n) for n in (4, 8, 16, 511, 512, 513, 1024, 5000)] + [bytes(600), b"123456789"]
    assert records.masked_crcs(parts).tolist() == [plain_crc(p) for p in parts]
    # the published check value of CRC-32C
    assert plain_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert records.masked_crcs([]).tolist() == []
    frame = bytearray(records.frames([bytes(range(40))])[0])
    assert records.unframed([bytes(frame)]) == [bytes(range(40))]
    for at in (0, 9, 20, 55):
        broken = bytearray(frame)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed([bytes(broken)])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_gives_the_library_ids(library):
    rnd = random.Random(3)
    odd = ["'s", "'LL", "İ", "ſ", "Σ", "ς", "é", "́", "ŉ", "<|endoftext|>", "<|startoftext|>x", "漢字", "😀", " ", "\x1c", "\x85",
           " ", "﻿", "\x00", "²", "¼", "½3", "ª", "­", "don't", "#*$%", "\r\n", "\x0c", "𝟘", "ß", "ΑΣ", "ДА", "<", "|", "</w>"]
    texts = ["".join(rnd.choice(odd + list("abcXYZ 019 \n\t'-")) for _ in range(rnd.randint(0, 80))) for _ in range(1500)] + ["", " ", "a" * 5000]
    model = records.WordEncoder(WORDS)
    assert model.by_word and all(model.encode(t).tolist() == library(t) for t in texts)


def test_records_round_trip(spark, docs, library):
    got = records.round_trip(docs, WORDS)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    rows = [(r["doc_id"], np.array([*library(r["text"]), 1], "<u4")) for r in docs.collect()]
    assert [r[0] for r in got] == [*sorted(i for i, _ in rows if i is not None), None]
    assert sorted((r[0] or -1, *r[2:]) for r in got) == sorted((i or -1, len(x), zlib.crc32(x.tobytes())) for i, x in rows)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]


def test_records_in_any_order_and_small_files(spark, docs, tmp_path, library):
    index = records.write_records(docs.repartition(3), str(tmp_path), WORDS, file_bytes=2000)
    assert index.select("file").distinct().count() > 3
    shuffled = records.read_records(index.orderBy(F.rand(4)), str(tmp_path), ids=True).collect()
    want = sorted((r["doc_id"] or -1, [*library(r["text"]), 1]) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in shuffled) == want
    one = records.read_records(index.filter("doc_id = 31"), str(tmp_path), ids=True).collect()
    assert [r["ids"] for r in one] == [[*library("z" * 20000), 1]]
    with pytest.raises(Exception, match="not the one that the index names"):
        records.read_records(index.withColumn("doc_id", F.lit(5).cast("long")), str(tmp_path)).collect()


def test_records_of_nothing(spark):
    assert records.round_trip(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def plain_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(d)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def test_whitening_against_plain_covariance(spark):
    rnd = random.Random(7)
    vectors = [[rnd.gauss(0, 1 + k) + (1000 if k == 2 else 0) for k in range(6)] for _ in range(150)]
    vectors += [vectors[0]] * 300 + [[v + 1e-9 for v in vectors[1]]]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5, [1e300] + [0.0] * 5, [1.0, 2.0]]
    rows = [(k, v, k, "x") for k, v in enumerate(vectors + bad)] + [(None, vectors[3], 0, "y"), (3, vectors[3], 0, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, component string").repartition(7)
    got = whitening.whiten(df).collect()
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in [(r[0], r[1]) for r in rows] if v in vectors]
    fit = sorted({tuple(x) for _, x in kept})
    n, cov = len(fit), plain_covariance(fit)
    sums = [sum(r[i] for r in fit) for i in range(6)]
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n}
    dev = {tuple(x): sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept}
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["deviation"]) for r in got if r["component"] == 2) \
        == sorted((-1 if i is None else i, dev[tuple(x)]) for i, x in kept)
    for c in range(4):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        want = {i: float((np.array(x) - np.array(sums) / n) @ vecs[:, c] / math.sqrt(values[c])) for i, x in kept}
        sign = math.copysign(1, mine[5] * want[5])
        assert all(abs(mine[i] * sign - want[i]) < 1e-9 for i in want)
        assert all(abs(r["explained"] - values[c] / np.trace(cov)) < 1e-12 for r in got if r["component"] == c + 1)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_polarisation_is_exact_with_large_steps(spark):
    rnd = random.Random(9)
    x = [[rnd.randint(-2**39, 2**39) for _ in range(3)] for _ in range(40)]
    fit = spark.createDataFrame([(v,) for v in x], "_x array<long>").repartition(3)
    n, sums = whitening.totals(fit, 3)
    assert (n, sums) == (40, [sum(v[i] for v in x) for i in range(3)])
    middle = [s // n for s in sums]
    cov = whitening.covariance(n, [s - n * m for s, m in zip(sums, middle)], whitening.squares(fit, middle))
    assert (cov == plain_covariance(x)).all()
    model = whitening.Whitener(n, sums, middle, cov, 3)
    assert model.deviation(np.array(x)) == [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]


def test_whitening_without_spread_or_rows(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r["vec_id"], r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] \
        == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0]) for k in range(5)], "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], "vec_id long, embedding array<double>")).count() == 0
