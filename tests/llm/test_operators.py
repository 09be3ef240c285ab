import collections
import hashlib
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from railspark.llm import bpe, chat, components, entry, exact_dedup, lm, near_dedup, packing, quality, substring_dedup, toxicity, warc

tokenizers = pytest.importorskip("tokenizers")


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def none_of(docs):
    return docs.filter("false")


@pytest.mark.parametrize("ranks", [None, entry.RANKS])
def test_bpe_equals_the_tokenizers_library(ranks):
    own, lib = bpe.Bpe(entry.VOCABULARY, ranks), tokenizers.Tokenizer.from_file(entry.VOCABULARY)
    rnd = random.Random(1)
    some = ["", "z" * 3000, "ab" * 500, "a  b   c\n \n d\t", "\x00\x01 \x02", "don't <|endoftext|>\n"]
    some += ["".join(rnd.choice("aabethhe  \n\t'sd.,01é\u00a0😀") for _ in range(rnd.randint(0, 50))) for _ in range(300)]
    for t, ids in zip(some, own.encode_batch(some)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert own.decode(want) == lib.decode(want, skip_special_tokens=False)


def test_token_digests_and_table(docs):
    got = bpe.token_digests(docs, entry.VOCABULARY)
    lib = tokenizers.Tokenizer.from_file(entry.VOCABULARY)
    want = []
    for i, t in texts(docs):
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert bpe.token_table(none_of(docs), entry.VOCABULARY).count() == 0


def test_quality_measures_against_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        t = "".join(rnd.choice("ab  \n#é") for _ in range(rnd.randint(0, 60)))
        w = t.replace("\n", " ").split(" ")
        w = [x for x in w if x]
        lines = [x for x in t.split("\n") if x.strip(" ")]
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k + j for k in range(len(w) - 2) for j in range(3) if seen[tuple(w[k:k + 3])] > 1}
        want = (len(w), sum(map(len, w)), t.count("#"), sum(x in lines[:k] for k, x in enumerate(lines)), len(cover))
        assert quality.measure(t)[:5] == want, t


def test_host_verdicts_shrink_and_reject(spark, docs):
    good, bad = " ".join(f"w{k}" for k in range(60)), "short"
    data = [(k, good, "fine") for k in range(40)] + [(100 + k, bad if k < 36 else good, "junk") for k in range(40)] + [(200, bad, "tiny")]
    data += [(201, good, "tiny"), (202, good, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[k].kept for k in range(40)) and not any(got[100 + k].kept for k in range(40))
    assert got[201].kept and got[202].kept and not got[200].kept
    assert 0.1 < got[201].host_rate < 0.6 and quality.judge(none_of(docs)).count() == 0
    assert quality.judge(docs).count() == docs.count()


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    how = {"content_hash": lambda c: F.substring(F.md5(c), 1, 1)} if weak else {}  # a weak hash has to be told apart by bytes
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = collections.defaultdict(list)
    for i, t in texts(docs):
        groups[low(t)].append(i)
    want = []
    for i, t in texts(docs):
        ids = groups[low(t)]
        keep = max([x for x in ids if x is not None], default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    assert sorted(rows(exact_dedup.duplicate_groups(docs, keep="max", **how)), key=str) == sorted(want, key=str)
    assert exact_dedup.duplicate_groups(none_of(docs)).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def near_brute(data, num, den):
    sets = {}
    for i, t in data:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    while True:
        new = {i: min([comp[j] for j in sets if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])] + [comp[i]]) for i in sets}
        if new == comp:
            return {i: (len(sets[i]), comp[i]) for i in sets}
        comp = new


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 150])
def test_near_duplicates(spark, block):
    rnd = random.Random(9)
    data = []
    for g in range(6):
        w = [f"w{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.choice([3, 5, 40, 90]))]
        for _ in range(10):
            v = list(w)
            for _ in range(rnd.randint(0, 2)):
                v[rnd.randrange(len(v))] = f"n{rnd.randint(0, 10 ** 6)}"
            data.append((len(data), " ".join(v)))
    data += [(900, ""), (901, None), (902, " \n")]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), num=85, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute([(i, t or "") for i, t in data], 85, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edge_rows(docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count() and near_dedup.near_duplicates(none_of(docs)).count() == 0
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert near_dedup.drop_near_copies(docs).columns == docs.columns


def test_sketch_fills_and_estimates():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 500):
        assert (near_dedup.sketch(rnd.integers(0, 1 << 63, n, dtype=np.uint64)) != np.iinfo(np.uint64).max).all()
    x = rnd.integers(0, 1 << 63, 1300, dtype=np.uint64)
    same = np.mean(near_dedup.sketch(x[:1000], 4096) == near_dedup.sketch(x[300:], 4096))
    assert abs(same - 700 / 1300) < 0.04


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40, 90)] + [(7, k) for k in range(200, 230)] + [(229, 3), (5, 5)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "u long, v long"))))
    assert set(got.values()) == {40, 3} and got[90] == 40 and got[215] == 3


@pytest.mark.parametrize("shard", [substring_dedup.SHARD, 1200])
def test_cut_repeats_against_all_positions(spark, docs, shard, monkeypatch):
    data = texts(docs) + [(500 + k, f"{k} " * 20 + "the shared passage " * 3 + "q" * 180 + f" {k}" * 40) for k in range(25)]
    counts = collections.Counter(t.encode()[k:k + 200] for _, t in data for k in range(len(t.encode()) - 199))
    want = []
    for i, t in data:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - 199):
            if counts[raw[k:k + 200]] > 1:
                gone[k:k + 200] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want.append((i, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "MERGE", 500)
    assert sorted(rows(substring_dedup.cut_repeats(df, shard=shard)), key=str) == sorted(want, key=str)


def test_without_repeats_keeps_rows_and_valid_text(docs):
    got = substring_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert substring_dedup.cut_repeats(none_of(docs)).count() == 0


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(4)
    for _ in range(30):
        parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 40))) for _ in range(6)]
        for size in (1, 4, 9):
            all_ = collections.Counter(p[k:k + size] for p in parts for k in range(len(p) - size + 1))
            for p, hit in zip(parts, substring_dedup.repeated_starts(parts, size)):
                assert hit.tolist() == [all_[p[k:k + size]] > 1 for k in range(len(p) - size + 1)]


def test_packing_plan_is_gapless_and_as_good_as_best_fit():
    for seed in range(60):
        rnd = random.Random(seed)
        cap = rnd.choice([8, 64, 1024])
        lengths = {n: rnd.randint(1, 40) for n in rnd.sample(range(1, cap + 1), min(cap, 30))}
        seqs, seen = collections.defaultdict(list), set()
        for n, rank, many, first, each, at in packing.plan(lengths, cap):
            for j in range(many):
                assert (n, rank + j) not in seen
                seen.add((n, rank + j))
                seqs[first + j // each].append((at + n * (j % each), n))
        assert len(seen) == sum(lengths.values())
        for pieces in seqs.values():
            end = 0
            for at, n in sorted(pieces):
                assert at == end
                end += n
            assert end <= cap
        room = []
        for n in sorted((n for n, c in lengths.items() for _ in range(c)), reverse=True):
            fit = min((r for r in room if r >= n), default=None)
            if fit is not None:
                room.remove(fit)
            room.append((cap if fit is None else fit) - n)
        assert len(seqs) <= len(room)


def test_pack_places_every_piece(docs):
    got = packing.pack(docs, entry.VOCABULARY, capacity=64, ranks=entry.RANKS).collect()
    lib = tokenizers.Tokenizer.from_file(entry.VOCABULARY)
    want = []
    for i, t in texts(docs):
        ids = lib.encode(t, add_special_tokens=False).ids + [2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        assert [a for a, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 64
    assert packing.pack(none_of(docs), entry.VOCABULARY).count() == 0


def test_chat_paths_rank_branches(spark):
    tree = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 2.0), (2, 1, 99, None), (3, 1, 2, 1.0), (3, 2, 1, 1.0)]
    df = spark.createDataFrame(tree, "tree long, node long, parent long, score double")
    got = collections.defaultdict(list)
    for r in chat.paths(df, branches=2).collect():
        got[r.tree, r["rank"]].append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5], (2, 1): [1]}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>\\", "\\<|end|>\n<<SYS>>", None, "", "\\\\", "é😀" * 5]
    data = [(c, k, "assistant" if k % 2 else "user", nasty[(c + k) % len(nasty)]) for c in range(7) for k in range(c + 1)]
    data += [(50, 0, "user", "same"), (50, 0, "user", "same"), (51, None, None, None)]
    got = {r.conv_id: r for r in chat.digests(chat.chains(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))).collect()}
    for c in range(7):
        turns = [(r, t or "") for i, _, r, t in data if i == c]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[50].n_turns == 2 and got[51].n_turns == 1


def test_warc_round_trip_with_segments(spark):
    big = "é" * 3000
    pages = [(1, "http://a/", big), (2, "http://b", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "", None), (6, "x y", "Q" * 70000)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, kind string")
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(df, segment=2000).collect()}
    for i, _, h in pages:
        raw = (h or "").encode()
        kind = ("revisit", 9) if i in (1, 2) else ("response", None)
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), *kind)
    assert warc.round_trip(none_of(df)).count() == 0


def test_warc_keeps_rows_that_share_a_page_id(spark):
    """Repeated ids with equal and different payloads, long and short, and null ids: rows out equal rows in."""
    a, b = "A" * 30000, "B" * 30000
    pages = [(1, a), (1, a), (2, b), (2, a + b), (3, "s"), (3, "s"), (3, "t"), (4, "m" * 1200), (5, "m" * 1200), (None, "n" * 40000), (None, "n" * 40000),
             (None, "o" * 50000), (None, "x"), (None, a), (None, "m" * 1200), (None, None)]
    first = {}
    for i, t in pages:
        if i is not None:
            first[t] = max(first.get(t, i), i)
    want = []
    for i, t in pages:
        raw, ref = (t or "").encode(), first.get(t) if len(t or "") >= 1000 else i
        ref = i if ref is None else ref
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if ref == i else "revisit", None if ref == i else ref))
    df = spark.createDataFrame([(i, "u", t, 0) for i, t in pages], "page_id long, url string, html string, record_id int").repartition(3)
    assert sorted(map(tuple, warc.round_trip(df, segment=2000).collect()), key=repr) == sorted(want, key=repr)


def test_warc_reports_missing_segments(spark, tmp_path):
    records = warc.page_records(7, "u", b"x" * 9000, hashlib.sha1(b"x" * 9000).hexdigest(), segment=2000)
    for name, some in (("whole", records), ("gap", records[:2] + records[3:])):
        where = str(tmp_path / name)
        spark.createDataFrame([(r,) for r in some], "record binary").select(F.col("record").cast("string")) \
            .write.option("lineSep", "\r\n").option("compression", "gzip").text(where)
        (got,) = warc.read_archives(spark, where, payloads=True).collect()
        assert got.complete == (name == "whole") and got.payload == (b"x" * 9000 if name == "whole" else None)


def test_dechunked_refuses_broken_framing():
    assert warc.dechunked(warc.chunked(b"a" * 10000)) == b"a" * 10000
    for bad in (b"", b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


def test_toxicity_learns_and_defines_edges(spark, docs):
    rnd = random.Random(2)
    plain = [f"w{k}" for k in range(50)]
    data = []
    for i in range(1200):
        w = [rnd.choice(plain) for _ in range(40)]
        if i % 5 == 0:
            w[rnd.randrange(40)] = rnd.choice(["nastya", "nastyb"])
        data.append((i, " ".join(w), int(i % 5 == 0)))
    d = spark.createDataFrame([(i, t) for i, t, _ in data] + [(5000, ""), (5001, None)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, lab).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97 and all(got[i].held_out for i in held)
    assert 0 <= got[5000].score == got[5001].score <= 1
    assert {r.score for r in toxicity.score(docs, none_of(lab)).collect()} == {0.0}


def test_lm_base_counts_and_window_scores(docs):
    got = lm.score(docs, entry.VOCABULARY, entry.RANKS).collect()
    words = [(i, t.encode().lower().split() + [None]) for i, t in texts(docs)]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in words)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(none_of(docs), entry.VOCABULARY).count() == 0


def test_lm_probabilities_sum_to_one_and_gradient_is_right():
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 3000, 200)
    model = lm.Lm(np.bincount(np.concatenate([np.arange(3000), ids]), minlength=lm.END + 1), lm.END + 1)
    pair = rnd.integers(0, 5, (model.slots, model.slots)).astype(float)
    model.cluster(pair)
    model.tables(pair)
    model.par["out"] = (rnd.standard_normal(model.par["out"].shape) * 0.1).astype(np.float32)
    x, y, _ = model.windows(ids[:70])
    total = 0
    for s in range(model.slots):  # over every possible next slot
        total += np.exp(model.forward(x[:1], np.full_like(y[:1], s))[0][0, 5].astype(float))
    assert abs(total - 1) < 1e-3
    for g in (lm.TOP, lm.TOP + 1):
        assert abs(np.exp(model.within[model.slot == g].astype(float)).sum() - 1) < 1e-3
    keep = model.forward(x, y)
    grad = model.gradient(keep[1])
    for name, at in (("Q", (1, 2)), ("V", (0, 3)), ("X", (2, 1)), ("dist", 1), ("E", (int(x[0, 20]), 4))):
        value = model.par[name][at]
        loss = []
        for step in (1e-2, -1e-2):
            model.par[name][at] = value + step
            loss.append(-model.forward(x, y)[0][y >= 0].astype(float).mean())
        model.par[name][at] = value
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[name][at]) < 2e-3 + 0.1 * abs(grad[name][at]), name


def lm_by_loops(model, x, y):
    """log p(class of y), token by token in double precision, by the formulas of the model."""
    p = {k: v.astype(float) for k, v in model.par.items()}
    out = []
    for row, goals in zip(x, y):
        for j, goal in enumerate(goals):
            last = lm.BEFORE - 1 + j
            seen = [i for i in range(last + 1) if row[i] >= 0]
            if goal < 0:
                out.append(0.0)
                continue
            query = p["E"][row[last]]
            a = np.array([query @ p["Q"] @ (p["E"][row[i]] @ p["K"]) / math.sqrt(lm.WIDTH) + p["dist"][last - i] for i in seen])
            a = np.exp(a - a.max())
            o = sum(w * (p["E"][row[i]] @ p["V"]) for w, i in zip(a / a.sum(), seen))
            z = np.maximum(query @ p["X"] + o @ p["O"] + p["b"], 0) @ p["out"] + model.cls_log[row[last]]
            out.append(z[model.cls[goal]] - np.log(np.exp(z).sum()))
    return np.array(out)


def test_a_batch_is_computed_in_parts_with_the_same_probabilities_and_gradients(monkeypatch):
    rnd = np.random.default_rng(9)
    ids = np.append(rnd.integers(0, 3000, 32 * 5 + 7), lm.END)
    model = lm.Lm(np.bincount(np.concatenate([np.arange(3000), ids]), minlength=lm.END + 1), lm.END + 1)
    pair = rnd.integers(0, 5, (model.slots, model.slots)).astype(float)
    model.cluster(pair)
    model.tables(pair)
    model.par["out"] = (rnd.standard_normal(model.par["out"].shape) * 0.1).astype(np.float32)
    x, y, _ = model.windows(ids)
    assert (x < 0).any() and (y < 0).any()  # the first window has masked inputs, the last one targets that do not exist
    got = np.where((y >= 0).ravel(), model.classes(x, y)[0], 0)
    assert abs(got - lm_by_loops(model, x, y)).max() < 1e-4
    whole, at, rows = model.gradients(model.classes(x, y)[2])
    sizes, classes = [], model.classes
    monkeypatch.setattr(lm, "SCORED", 2)
    monkeypatch.setattr(model, "classes", lambda x, y: sizes.append(len(x)) or classes(x, y))
    parts, ids_of, rows_of = model.step(x, y)
    assert sizes == [2, 2, 2] and (ids_of == at).all() and abs(rows_of - rows).max() < 1e-6
    assert all(abs(parts[k] - whole[k]).max() < 1e-6 for k in whole)
    for b in (0, 1):  # a batch without targets, and one without inputs, moves nothing
        none, at, _ = model.step(np.full_like(x, -1) if b else x, np.full_like(y, -1))
        assert all(not v.any() for v in none.values()) and (len(at) == 0) == bool(b)


def test_the_output_layer_still_ends_at_80():
    model = lm.Lm(np.ones(lm.END + 1), lm.END + 1)
    model.par["b"][:] = 100
    model.par["out"][:, 3] = 1
    x, y, _ = model.windows(np.array([5, 6, 7, lm.END]))
    got = model.classes(x, np.where(y >= 0, np.flatnonzero(model.cls == 3)[0], -1))[0][(y >= 0).ravel()]
    assert np.isfinite(got).all() and abs(got).max() < 1e-3


def test_short_texts_share_one_array_of_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 10)
    texts = [[np.array(t, "<u2").tobytes() for t in b] for b in ([[1, 2], [3]], [[4] * 6], [], [[5] * 4, [6]], [[7]])]
    assert [x.tolist() for x in lm.joined(iter(texts))] == [[1, 2, 3, 4, 4, 4, 4, 4, 4, 5, 5, 5, 5, 6], [7]]
    assert list(lm.joined(iter([[], []]))) == []
    tokens = spark.createDataFrame([(x,) for b in texts for x in b], "ids binary")
    assert lm.summed(tokens, lambda ids: np.bincount(ids, minlength=9), 9, 4).tolist() == [0, 1, 1, 1, 6, 4, 1, 1, 0]


def test_the_tables_need_little_beside_themselves():
    rnd = np.random.default_rng(6)
    model = lm.Lm(np.arange(lm.END + 1)[::-1].astype(float), lm.END + 1)
    pair = rnd.integers(0, 5, (model.slots, model.slots)).astype(float)
    own = rnd.integers(0, 3, (lm.END + 1, lm.CLASSES)).astype(np.float32)
    model.cluster(pair)
    for f, x in ((model.tables, pair), (model.refine, own)):
        before = model.cls_log.copy()
        tracemalloc.start()
        f(x)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 70e6, f  # 134 and 78 MB when every step took the whole tables
    wide = (own[7] + 20 * np.exp(before[7])) / (own[7].sum() + 20)
    assert abs(np.exp(model.cls_log[7]) - wide).max() < 1e-6 and model.slot_log.shape == pair.shape


def test_a_token_is_scored_once_however_windows_fall():
    rnd = np.random.default_rng(5)
    model = lm.Lm(np.ones(lm.END + 1), lm.END + 1)
    model.within[:] = -1.0
    n = [1, 31, 32, 33, 100]
    per = [sum((goal >= 0).sum() for goal in [model.windows(rnd.integers(0, 99, k))[2]]) for k in n]
    assert per == n


def test_the_rounds_train_on_every_window_once(spark):
    rnd = np.random.default_rng(2)
    ids = [rnd.integers(0, 50, n).astype("<u2") for n in (1, 32, 33, 500, 1601)]
    tokens = spark.createDataFrame([(k << 30, t.tobytes()) for k, t in enumerate(ids)], "row long, ids binary")
    model = lm.Lm(np.bincount(np.concatenate(ids), minlength=lm.END + 1), lm.END + 1)
    rounds = [lm.train_round(tokens, model, turn, 0.01) for turn in range(lm.ROUNDS)]
    assert sum(windows for _, windows in rounds) == sum(-(-len(t) // lm.NEW) for t in ids)


def test_lm_tells_rare_subwords_apart(spark):
    rnd = np.random.default_rng(4)
    ids = [np.concatenate([rnd.integers(0, lm.TOP, 6000), rnd.integers(3000, 9000, 60).repeat(2), [40000, 41000] * 9]) for _ in range(5)]
    ids = [np.append(t, lm.END).astype("<u2") for t in ids + [np.arange(lm.TOP).repeat(3)]]
    data = [(k, k // 2, k == 4, t.tobytes()) for k, t in enumerate(ids)]
    tokens = spark.createDataFrame(data, "row long, chunk long, _held boolean, ids binary")
    model, known = lm.fit(tokens)
    assert len(model.par["E"]) == lm.END + 1
    size, rare = len(model.slot), lambda t: model.slot[t] >= lm.TOP
    pairs = [[(int(b) * size + int(t), b, t) for b, t in zip([lm.END, *x[:-1]], x)] for x in ids]
    count = collections.Counter(p for k, x in enumerate(pairs) if k != 4 for p, b, t in x if rare(b) or rare(t))
    want = {(k // 2, p): count[p] for k, x in enumerate(pairs) for p, _, _ in x if count[p]}
    assert {(r.chunk, r.pair): r.n for r in known.collect()} == want
    own = np.zeros((size, lm.CLASSES))
    for p, n in count.items():
        if rare(p // size):
            own[p // size, model.cls[model.slot[p % size]]] += n
    assert (own == model.own).all() and abs(np.exp(model.cls_log[[40000, 41000, 50000]]).sum(1) - 1).max() < 1e-3
    everything = np.arange(size)
    for b in (40000, int(model.top[5]), 50000):  # p(token | class, previous) sums to one over each class
        n = np.array([count[b * size + t] for t in range(size)])
        slots = model.slot[everything]
        log = model.slot_log[model.slot[b], slots] + model.within
        at = np.full(size, rare(b)) | rare(everything)
        log[at] += model.exact(np.full(at.sum(), b), everything[at], n[at])
        assert abs(np.bincount(model.cls[slots], np.exp(log.astype(float)), lm.CLASSES)[np.unique(model.cls[slots])] - 1).max() < 1e-3
    more = {r.row: r.more for r in lm.exact_scores(tokens, known, model).collect()}
    for k, x in enumerate(pairs):
        x = np.array([(b, t, count[p]) for p, b, t in x if rare(b) or rare(t)], np.int64).reshape(-1, 3)
        assert abs(more[k] - model.exact(*x.T).sum() / math.log(10)) < 1e-6
    assert model.exact(np.array([40000, 40000]), np.array([41000, 40000]), np.array([count[40000 * size + 41000], 0])).argmax() == 0


def test_drop_toxic_judges_each_row_by_its_text(spark):
    bad, good = "you are a stupid rotten liar and we hate you " * 3, "the river runs past the quiet old mill today " * 3
    rows = [(i, f"{bad if i % 3 == 0 else good} {i % 5}") for i in range(400)]
    more = [(None, bad), (None, good), (900, None), (901, ""), (902, bad), (902, good), (902, good)]
    d = spark.createDataFrame([(i, t, 0.5, 7) for i, t in rows + more], "doc_id long, text string, score double, toxicity int")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert not [t for _, t in left if t and "stupid" in t]
    assert sum(i is not None and i < 400 for i, _ in left) == sum(i % 3 != 0 for i in range(400))
    assert (None, good) in left and left.count((902, good)) == 2
    assert toxicity.drop_toxic(d.limit(0), lab).count() == 0


def test_dedup_stages_judge_rows_not_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(5, a), (3, a), (5, b), (7, c), (7, c), (None, c.upper()), (None, d), (None, d), (8, None), (9, "")]
    cols = "doc_id long, text string, n int"
    copies = spark.createDataFrame([(i, t, 1) for i, t in rows], cols)
    for keep, want in (("min", [(3, a), (5, b), (7, c), (None, d), (8, None)]), ("max", [(5, a), (5, b), (7, c), (None, d), (9, "")])):
        got = exact_dedup.drop_copies(copies, keep=keep)
        assert got.columns == copies.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    near = spark.createDataFrame([(i, t and t + f" end{k}", 1) for k, (i, t) in enumerate(rows)], cols)
    got = near_dedup.drop_near_copies(near)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == near.columns
    assert sorted((str(i), t[:1] if t else t) for i, t in kept if t) == [("3", "a"), ("5", "b"), ("7", "c"), ("None", "d")]
    assert {i for i, t in kept if not t} == {8, 9}
    # the suffix stage then finds no repeats: every text is still there once
    cut = substring_dedup.without_repeats(exact_dedup.drop_copies(copies))
    assert sorted(r.text or "" for r in cut.collect()) == sorted(["", a, b, c, d])


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as cp
    data = docs.filter("doc_id is not null").select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(1).cast("long").alias("n_chars"), "kept")
    data.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in cp.STAGES[:-1]:
        nxt = stage(spark, cur, str(tmp_path))
        assert nxt.columns == data.columns, name
        cur = nxt.checkpoint()
        left[name] = sorted(r.doc_id for r in cur.select("doc_id").collect())
    ids = sorted(r.doc_id for r in data.select("doc_id").collect())
    assert left["toxicity"] == ids
    assert 21 not in left["exact_dedup"] and {1, 2, 22, 23} <= set(left["exact_dedup"])
    assert not {22, 23} & set(left["near_dedup"]) and left["suffix_dedup"] == left["near_dedup"]
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == set(left["suffix_dedup"])


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(70)) for x in "abc")
    data = [(1, a), (1, b), (3, b + " more"), (3, c), (2, c + " more"), (1, a), (9, a.upper())]
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), num=85).collect()
    by_row = near_brute(list(enumerate(t for _, t in data)), 85, 100)
    least = {}
    for k, (i, _) in enumerate(data):
        least[by_row[k][1]] = min(i, least.get(by_row[k][1], i))
    want = sorted((i, by_row[k][0], least[by_row[k][1]]) for k, (i, _) in enumerate(data))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_a_frequent_length_is_ranked_in_many_shards(spark):
    data = [(k % 50, k, 0, 7 if k % 3 else 5, k % 4) for k in range(400)] + [(1, 900, 0, 64, 1)]
    pieces = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long")
    for shard in (3, 1 << 16):
        got = packing.place(pieces, 64, shard).collect()
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(data)
        rooms = collections.defaultdict(list)
        for r in got:
            rooms[r.sequence_id].append((r.offset, r.length))
        for places in rooms.values():
            ends = [0, *(o + n for o, n in sorted(places))]
            assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 64
        assert len(rooms) == len({s for n, f, many, first, each, _ in packing.plan(collections.Counter(x[3] for x in data), 64)
                                  for s in range(first, first - (-many // each))})


def test_stages_keep_columns_that_look_like_their_own(spark):
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(1, passage + " one", 1), (2, passage + " two and some more words", 2), (2, "other", 3), (4, "other", 4)]
    base = spark.createDataFrame(rows, "doc_id long, text string, n int")
    names = ["_id", "_text", "_key", "_k", "_gone", "spans", "_part", "_p", "_n", "_stays", "_hash", "text_row", "n_chars_row", "_content"]
    own = base.select("*", *[F.concat(F.lit(c), F.col("n")).alias(c) for c in names])
    for stage, left in ((exact_dedup.drop_copies, {1, 2, 3}), (near_dedup.drop_near_copies, {1, 3}), (substring_dedup.without_repeats, {1, 2, 3, 4})):
        got = stage(own)
        assert got.columns == own.columns
        out = got.collect()
        assert {r.n for r in out} == left
        assert all(r[c] == f"{c}{r.n}" for r in out for c in names)
        assert stage(none_of(own)).count() == 0


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline as cp
    rnd = random.Random(8)
    say = lambda n: " ".join(f"{rnd.choice(['river', 'mill', 'stone', 'field'])}{rnd.randint(0, 9999)}" for _ in range(n))
    passage, calm = say(60), "the quiet old mill runs past today".split()  # both kinds have one length
    data = [(i, say(40) + (" you stupid rotten liar we hate you" * 6 if i % 3 == 0 else "".join(" " + rnd.choice(calm) for _ in range(42)))) for i in range(240)]
    clean = [t for i, t in data if i % 3]
    data += [(1000 + k, clean[k].upper() if k % 2 else clean[k]) for k in range(12)]
    data += [(1100 + k, clean[k] + " tail") for k in range(6, 18)]
    data += [(1200 + k, say(30 + k) + " " + passage + " " + say(20)) for k in range(8)] + [(1300, ""), (1301, None), (1302, say(1500))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = sorted((i, t or "") for i, t in data if "stupid" not in (t or ""))
    first = {}
    for i, t in left:
        first.setdefault(t.lower(), (i, t))
    left = sorted(first.values())
    part = near_brute(left, 80, 100)
    left = [(i, t) for i, t in left if part[i][1] == i]
    counts = collections.Counter(t[k:k + 200] for _, t in left for k in range(len(t) - 199))
    library, want = tokenizers.Tokenizer.from_file(entry.VOCABULARY), []
    removed = 0
    for i, t in left:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if counts[t[k:k + 200]] > 1:
                gone[k:k + 200] = True
        removed += int(gone.sum())
        ids = library.encode("".join(c for c, g in zip(t, gone) if not g), add_special_tokens=False).ids + [2]
        want += [(i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), 1024))]
    got = cp.run(spark, str(tmp_path)).collect()
    assert removed > 8 * 200 and sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_key_filter_keeps_every_key_and_few_others(spark):
    """op7 sends only texts of candidates through its shuffle: the filter loses none and passes few others."""
    from railspark.llm.common import likely_in
    rows = spark.range(20000).withColumnRenamed("id", "_id")
    for keys in (rows.filter("_id % 50 = 0"), rows.filter("_id < 0"), rows.filter("_id % 50 = 0").unionByName(rows.filter("_id = 7"))):
        want = {r[0] for r in keys.collect()}
        got = {r[0] for r in likely_in(rows, "_id", keys.withColumnRenamed("_id", "k")).collect()}
        assert want <= got and len(got - want) <= 4000 * bool(want)
    odd = spark.createDataFrame([(None,), (5,), (-3,)], "_id long")
    assert {r[0] for r in likely_in(odd, "_id", odd).collect()} >= {5, -3}
