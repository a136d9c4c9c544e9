import random

import numpy as np

from marlstone.llm import common
from marlstone.llm import overlap as O

SCHEMA = "case_id string, question string, split string, source string"


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(2, 4))) for _ in range(300)]
    return ["为什么说" + "，请以".join(rng.sample(words, 12)) + "为例说明？" for _ in range(n)], words


def table(spark, rows):
    return {"questions": (spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), "case_id", "question", "split")}


def found(spark, rows):
    return {(r["train_id"], r["eval_id"]) for r in O.near_pairs(table(spark, rows)).collect()}


def test_near_pairs(spark):
    t, words = texts(400, 1)
    rows = [(f"t{i}", x, "train") for i, x in enumerate(t)]
    want = set()
    for i in range(0, 40):
        x = t[i]
        if i % 4 == 0:
            x = "模拟面试题：" + x.replace("，", ", ").replace("？", " ?")
        elif i % 4 == 1:
            k = len(x) // 2
            x = x[:k] + x[k + 1] + x[k] + x[k + 2 :]
        elif i % 4 == 2:
            parts = x.split("，请以")
            parts[3], parts[8] = words[0], words[1]
            x = "，请以".join(parts)
        rows.append((f"e{i}", x, random.Random(i).choice(["dev", " Test\t", "TEST"])))
        want.add((f"t{i}", f"e{i}"))
    for i in range(40, 60):  # too much replaced
        parts = t[i].split("，请以")
        for k in range(0, 8):
            parts[k] = words[(i * 7 + k) % 300]
        rows.append((f"f{i}", "，请以".join(parts), "dev"))
    rows += [("n1", t[0], None), ("n2", None, "dev"), ("n3", " …", "dev"), ("n4", "", "train"), (None, t[0], "dev")]
    assert found(spark, rows) == want


def test_copies_of_one_text_and_repeats(spark):
    t, _ = texts(30, 2)
    rows = [(f"t{i}", t[i % 30] if i % 3 else t[0], "train") for i in range(90)] + [("e1", t[0], "dev"), ("e1", t[0], "dev"), ("e2", t[0] + "。", "test")]
    got = found(spark, rows)
    hot = {r[0] for r in rows if r[2] == "train" and r[1] == t[0]}
    assert got == {(h, e) for h in hot for e in ("e1", "e2")}


def test_a_group_of_near_copies_is_no_frame(spark):
    t, words = texts(600, 5)
    rng = random.Random(6)

    def edited(x):
        parts = x.split("，请以")
        for k in rng.sample(range(1, 11), 2):
            parts[k] = rng.choice(words)
        return "，请以".join(parts)

    group = [edited(t[0]) for _ in range(300)]
    rows = [(f"t{i}", x, "train") for i, x in enumerate(t[1:])] + [(f"g{i}", x, "train") for i, x in enumerate(group)] + [("e0", t[0], "dev")]
    flat = lambda x: set(O.grouped(*common.squeezed_flat([x]))[0][1].hashes.tolist())
    base = flat(t[0])
    want = {(f"g{i}", "e0") for i, x in enumerate(group) if len(base & flat(x)) >= 0.55 * len(base | flat(x))}
    got = found(spark, rows)
    assert len(want) > 200 and len(want & got) >= 0.93 * len(want) and all(g.startswith("g") for g, _ in got)


def test_empty_and_short(spark):
    assert found(spark, [("a", "短", "train"), ("b", "短。", "dev")]) == {("a", "b")}
    empty = spark.createDataFrame([], SCHEMA)
    assert O.near_pairs({"questions": (empty, "case_id", "question", "split")}).count() == 0


def test_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    common_part = np.concatenate([a[:200], b[:100]])
    both = O.Shingled(np.concatenate([a, common_part]), np.array([0, 300, 600]))
    m = O.minhashes(both)
    j = O.jaccard(a, common_part)
    assert abs((m[0] == m[1]).mean() - j) < 0.25 and abs(j - 0.5) < 1e-9


def test_pairs_at_the_threshold_share_a_band_and_pass_the_sketch():
    rng = np.random.default_rng(4)
    n, shared, own = 400, 64, 36  # Jaccard 64 / 136 = 0.47
    lost = []
    for _ in range(n):
        both, a, b = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (shared, own, own))
        m = O.minhashes(O.Shingled(np.concatenate([both, a, both, b]), np.array([0, shared + own, 2 * (shared + own)])))
        bands, sketches = O.bands(m, 1), O.sketches(m).view(np.uint8)
        lost.append(not (bands[0] == bands[1]).any() or (sketches[0] == sketches[1]).mean() < O.LEAST_AGREE)
    assert np.mean(lost) < 0.04


def test_flat_squeeze_equals_plain():
    samples = ["Ａb，C１ ​你好－_é", "école ΣΑΣ", "", "İx", "😀a字", "ﬁ①²", "한글"]
    flat, offsets = common.squeezed_flat(samples)
    got = ["".join(map(chr, flat[offsets[i] : offsets[i + 1]])) for i in range(len(samples))]
    assert got == [common.squeeze(s) for s in samples]
    assert len(set(common.fingerprints(flat, offsets, 1).tolist())) == len(set(got))


def test_report(spark):
    t, _ = texts(25, 3)
    rows = [(f"t{i}", x, "train") for i, x in enumerate(t)] + [("e", t[0], "dev"), ("f", t[1], "test")]
    got = {r["eval_split"]: (r["pairs"], r["exact"]) for r in O.overlap_report(O.near_pairs(table(spark, rows))).collect()}
    assert got == {"dev": (1, 1), "test": (1, 1)}


def test_summary_counts_as_the_pairs_do(spark):
    t, _ = texts(25, 8)
    rows = [(f"t{i}", t[i % 20], "train") for i in range(60)] + [(f"e{i}", t[i % 12] + "。" * (i % 2), ("dev", "test")[i % 2]) for i in range(30)] + [("e1", t[1] + "。", "test")]
    own = [("both", t[3], "train"), ("both", t[3], "dev")]  # a row on both sides is no pair with itself
    for more, columns in (([], ("source", "eval_split", "pairs", "eval_rows", "train_rows", "exact")), (own, ("source", "eval_split", "pairs", "exact"))):
        report = lambda df: {tuple(r[c] for c in columns) for r in df.collect()}
        assert report(O.overlap_summary(O.near_links(table(spark, rows + more)))) == report(O.overlap_report(O.near_pairs(table(spark, rows + more)))) != set()


def test_marks_keep_every_bucket_of_both_sides(spark):
    rng = np.random.default_rng(3)
    numbers = rng.integers(0, 2**40, (50, 2))
    numbers[25:30] = numbers[:5]
    df = spark.createDataFrame([(1 + (i >= 25), bytearray(x.tobytes())) for i, x in enumerate(numbers)], "side int, bands binary")
    marks = O._marks(df.repartition(3), 1 << 20)
    kept = O._marked(marks[2], O._cells(numbers[:25].ravel(), 1 << 20)).reshape(-1, 2)
    assert kept[:5].all() and kept[5:].mean() < 0.1


def test_only_pairs_likely_by_their_sketches_leave_the_join(spark):
    rng = np.random.default_rng(6)

    def share(same):
        m = rng.integers(0, 2**32, (1000, 2, O.BANDS * O.ROWS), dtype=np.uint32)
        alike = rng.random((1000, O.BANDS * O.ROWS)) < same
        m[:, 1][alike] = m[:, 0][alike]
        a, b = (O.sketches(m[:, k]) for k in (0, 1))
        want = (a.view(np.uint8) == b.view(np.uint8)).sum(axis=1)
        df = spark.createDataFrame(np.hstack([O.packed(a), O.packed(b)]).tolist(), "a0 long, a1 long, a2 long, b0 long, b1 long, b2 long")
        got = [r[0] for r in df.select(O.agreeing([df.a0, df.a1, df.a2], [df.b0, df.b1, df.b2])).collect()]
        assert got == want.tolist()
        return np.mean(want >= round(O.LEAST_AGREE * O.SKETCH))

    assert share(O.THRESHOLD) > 0.995 and share(0.1) < 0.12


def test_few_entries_without_a_partner_go_on_if_bitmaps_are_well_filled(spark):
    rng = np.random.default_rng(7)
    numbers = rng.integers(0, 2**40, (12000, O.BANDS))
    numbers[:50] = numbers[-50:]  # 50 evaluation texts are in the buckets of 50 training texts
    side = np.where(np.arange(12000) < 3000, 2, 1)
    rows = [(int(k), i, bytearray(24), bytearray(x.tobytes())) for i, (k, x) in enumerate(zip(side, numbers))]
    heads = spark.createDataFrame(rows, "side int, fp long, sketch binary, bands binary").repartition(3)
    entries, _ = O.meeting_entries(heads, O.PIECE)  # a fifth of the cells is set by evaluation
    got = {(r["side"], r["band"], r["fp"]) for r in entries.collect()}
    want = {(int(side[i]), int(n), i) for i in [*range(50), *range(11950, 12000)] for n in numbers[i]}
    assert want <= got and len(got - want) < 0.06 * numbers.size


def test_jaccards_are_those_of_each_pair():
    t, _ = texts(40, 9)
    counts = np.ones(O.BUCKETS, dtype=np.float32)
    x, y = [*t, "", "短"], [*t[1:], t[0], t[0], "a short one in letters"]
    y[3] = x[3][:40] + y[3][40:]

    def shingles(text):
        found = O.grouped(*common.squeezed_flat([text]))
        return O.kept(found[0][1], counts, 20).hashes if found else np.zeros(0, dtype=np.uint64)

    got = O.jaccards(O.distinct_shingles(x, counts, 20), O.distinct_shingles(y, counts, 20), len(x))
    assert got.tolist() == [O.jaccard(shingles(a), shingles(b)) for a, b in zip(x, y)] and got[3] > 0.1


def test_minhashes_and_shingles_do_not_depend_on_blocks(monkeypatch):
    t, _ = texts(60, 10)
    flat, offsets = common.squeezed_flat([*t, "长" * 400])
    want = [(f.hashes, O.minhashes(f)) for _, f in O.grouped(flat, offsets)]
    monkeypatch.setattr(O, "BLOCK", 97)
    monkeypatch.setattr(common, "BLOCK", 89)
    got = [(f.hashes, O.minhashes(f)) for _, f in O.grouped(flat, offsets)]
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(want, got, strict=True))
