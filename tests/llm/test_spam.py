import random

import pytest

from marlstone.llm import spam

SENTENCES = "复述项目时按背景任务行动结果排列。|很多同学只背结论却说不清接口为什么会超时。|小组才约定每周做一次对照实验。|听到追问之后先复述问题再说明步骤。|引用材料时写明出处避免误解。|表格左列写模块右列写负责人。|这份报告比口头保证更有用。|先做抽样检查再决定要不要压缩风险。".split("|")


def pages():
    rng = random.Random(1)
    kw = ["保研资料", "复试真题", "简历优化", "导师套磁"]
    good = [(i, "".join(rng.sample(SENTENCES, 6)), "n") for i in range(150)]
    article = [(200 + i, "".join(rng.sample(SENTENCES, 6)) + "\n" + " ".join("#" + rng.choice(kw) for _ in range(3)), "n") for i in range(10)]
    linked = [(230 + i, "\n".join(f"{s} https://a.example/{rng.randrange(999)}" for s in rng.sample(SENTENCES, 5)), "n") for i in range(10)]
    numbered = [(260 + i, "\n".join(f"{k}. {s}" for k, s in enumerate(rng.sample(SENTENCES, 6), 1)), "n") for i in range(10)]
    stuffed = [(300 + i, (rng.choice(SENTENCES) if i % 2 else "") + rng.choice("，/_、").join(rng.choice(kw) for _ in range(60)), "s") for i in range(10)]
    links = [(330 + i, "\n".join(f"[{rng.choice(kw)}](http://b.example/p/{rng.randrange(999)})" for _ in range(20)), "s") for i in range(10)]
    tags = [(360 + i, " ".join("#" + rng.choice(kw) + str(rng.randrange(2020, 2026)) for _ in range(40)), "s") for i in range(10)]
    goods = [(390 + i, "\n".join(f"{rng.choice(kw)} ￥{rng.randrange(400)} 包邮 SKU{rng.randrange(10**6)} {rng.choice(kw)}" for _ in range(25)), "s") for i in range(10)]
    return good + article + linked + numbered + stuffed + links + tags + goods


def test_pages(spark):
    rows = pages() + [(900, None, "n"), (901, "", "n"), (902, "短", "n"), (903, "".join(SENTENCES[i % 8] + f"第{i}次" for i in range(3)) * 1, "n"), (300, pages()[180][1], "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spam string")
    got = {r["doc_id"] for r in spam.spam_pages(df).collect()}
    assert got == {r[0] for r in rows if r[2] == "s"}
    assert spam.score_pages(df).count() == len(rows)


def test_word_salad(spark):
    rng = random.Random(2)
    words = [f"w{''.join(rng.choice('abcdefgh') for _ in range(4))}" for _ in range(60)]
    pairs = {w: rng.sample(words, 2) for w in words}

    def chain(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(rng.choice(pairs[out[-1]]))
        return " ".join(out)

    rows = [(i, chain(60)) for i in range(300)] + [(1000 + i, " ".join(rng.choice(words) for _ in range(60))) for i in range(3)]
    got = spam.score_pages(spark.createDataFrame(rows, "doc_id bigint, text string")).where("reason = 'salad'")
    assert {r["doc_id"] for r in got.collect()} == {1000, 1001, 1002}


def test_copies_are_not_the_corpus(spark):
    rng = random.Random(4)
    kw = ["保研资料", "复试真题", "简历优化", "导师套磁"]
    good = [(i, "".join(rng.sample(SENTENCES, 6))) for i in range(150)]
    own = "某校夏令营名额有限先到先得，往年学员分布各地欢迎比较，报价随季节浮动请勿转载。"
    page = own + "，".join(rng.choice(kw) for _ in range(18))
    copies = [(1000 + i, page if i % 2 else page.replace("，", ", ")) for i in range(150)]
    got = {r["doc_id"]: r for r in spam.score_pages(spark.createDataFrame(good + copies, "doc_id bigint, text string")).collect()}
    alone = {r["doc_id"]: r for r in spam.score_pages(spark.createDataFrame(good + copies[:1], "doc_id bigint, text string")).collect()}
    assert 0.45 <= alone[1000]["repeated"] < 0.75 and alone[1000]["reason"] == "repetition"
    assert {d for d, r in got.items() if r["spam"]} == {d for d, _ in copies}


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "字词句" * 100_000)], "doc_id bigint, text string")
    assert spam.spam_pages(df.limit(0)).count() == 0
    assert spam.score_pages(df).first()["words"] == 300_000


@pytest.mark.parametrize("text,want", [("a https://x.example/y b", ["a", "\x01", "b"]), ("#标签 字", ["\x02", "字"]), ("￥12 SKU99881 Don't", ["\x03", "\x03", "don't"]), (None, [])])
def test_words(text, want):
    assert spam.words(text) == want


def test_salad_of_the_corpus_own_words_and_what_is_none(spark):
    """Words of real pages in drawn order are salad, in any frequency; the pages, foreign texts and rare words are not."""
    t = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").select("text").collect()]
    rng = random.Random(5)
    known = [x for x in t if len(spam.words(x)) >= 60][:40]

    def shuffled(x):
        w = spam.words(x)
        rng.shuffle(w)
        return " ".join(w)

    salads = [(100_000 + i, shuffled(x)) for i, x in enumerate(known)]
    foreign = [(200_000, " ".join(f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)))]
    got = {r["doc_id"]: r["reason"] for r in spam.score_pages(spark.createDataFrame(list(enumerate(t)) + salads + foreign, "doc_id bigint, text string")).collect()}
    assert sum(got[i] is not None for i, _ in salads) >= 38 and sum(got[i] == "salad" for i, _ in salads) >= 36
    assert got[200_000] is None and not any(got[i] == "salad" for i in range(len(t)))
