from marlstone.llm import pairs

SCHEMA = "case_id string, question string, answer string, answerable boolean, abstained boolean, defect string"
Q = "为什么说动机上的取舍会影响线上评测，请以缓存接口的偶发的堆积为例，用抽样核对论证？"
A = "结论是缓存接口决定了线上评测能否继续。当时遇到偶发的堆积，我用抽样核对逐步确认原因。面对导师的追问，我提交了公开的报告，并反思动机上的取舍。"
E = "In short, the cache endpoint decided whether the online review could go on. We filed a public report and thought about the motivation trade-off."


def found(spark, rows):
    base = [(f"b{i}", Q + str(i), A.replace("公开", w), True, False, None) for i, w in enumerate(["公开", "脱敏", "最小", "分级", "滚动"] * 4)]
    df = spark.createDataFrame(base + rows, SCHEMA)
    return {r["case_id"]: r["defect"] for r in pairs.flag_broken_pairs(df).collect()}


def test_defects(spark):
    rows = [
        ("null", Q, None, True, False, "x"), ("blank", Q, " ​　", True, None, None), ("mark", Q, "……", None, None, None), ("label", Q, "答案：待补充", True, False, None), ("cited", Q, "[S1] [S2]", True, False, None),
        ("abstains", Q, "", False, True, None), ("empty_no_flag", Q, "", False, False, None),
        ("refusal", Q, "抱歉，我无法回答这个问题，请咨询相关老师。", True, True, None), ("may_refuse", Q, "抱歉，我无法回答这个问题。", False, True, None), ("refusal_en", "Why does it matter?", "Unfortunately, I can't help with that; see the official notice instead.", True, False, None),
        ("no_refusal", Q, A + "有人拒绝回答追问，我便改成书面答复。", True, False, None),
        ("echo", Q, f"您的问题是：{Q}", True, False, None), ("echo_part", Q, Q[: len(Q) * 3 // 4], True, False, None), ("repeats_then_answers", Q, Q + "\n" + A, True, False, None),
        ("english", Q, E, True, False, None), ("asked_english", Q + "请用英文回答。", E, True, False, None), ("japanese", Q, "まず背景を説明し、次に原因を確かめます。最後に短い報告をまとめます。", True, False, None),
        ("cut", Q, A[: A.index("提交了公开") + 3], True, False, None), ("comma", Q, A[: A.index("，我用") + 1], True, False, None), ("open", Q, A[:20] + "（例如", True, False, None), ("no_stop", Q, A.rstrip("。") + " [S1]", True, False, None),
        ("fine", Q, A, True, False, None), ("no_question", None, A, True, False, None),
    ]
    got = found(spark, rows)
    want = {
        "null": "empty", "blank": "empty", "mark": "empty", "label": "empty", "cited": "empty", "abstains": None, "empty_no_flag": "empty", "refusal": "refusal", "may_refuse": None, "refusal_en": "refusal",
        "no_refusal": None, "echo": "echo", "echo_part": "echo", "repeats_then_answers": None, "english": "language", "asked_english": None, "japanese": "language", "cut": "truncated", "comma": "truncated",
        "open": "truncated", "no_stop": None, "fine": None, "no_question": None,
    }
    assert {k: got[k] for k in want} == want


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pairs.defects(empty).count() == 0
    rows = [("a", Q, A, True, False, None)] * 3 + [("long", Q, A * 2000, True, False, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pairs.flag_broken_pairs(df)
    assert out.count() == 2 and out.where("defect is not null").count() == 0
    assert set(out.columns) == {"case_id", "question", "answer", "copy_ratio", "defect"}


def test_ends_that_say_more_is_to_come(spark):
    rows = [
        ("few_points", Q, "我的回答分四点。第一，先看现象。第二，当时遇到偶发的堆积，我用抽样核对逐步确认原因。", True, False, None), ("all_points", Q, "我的回答分两点。第一，先看现象。第二，当时遇到偶发的堆积，我用抽样核对逐步确认原因。", True, False, None),
        ("few_points_en", "Why?", "There are three points. First, the cache endpoint decided it. Second, we filed a public report.", True, False, None),
        ("next_mark", Q, A + "具体包括以下几点：1.", True, False, None), ("next_ordinal", Q, A + "第三，", True, False, None),
        ("ellipsis", Q, A[: A.index("提交了公开") + 3] + "…", True, False, None),
    ]
    got = found(spark, rows)
    assert {k: got[k] for k, *_ in rows} == {"few_points": "truncated", "all_points": None, "few_points_en": "truncated", "next_mark": "truncated", "next_ordinal": "truncated", "ellipsis": "truncated"}


def test_no_size_decides(spark):
    refusal = "抱歉，我无法回答这个问题，请咨询相关老师。"
    rows = [("long_refusal", Q, refusal * 40, True, False, None), ("short_echo", "什么是召回", "什么是召回", True, False, None), ("many_echoes", Q, Q * 120, True, False, None), ("echo_then_answer", Q, Q * 60 + A, True, False, None)]
    got = found(spark, rows)
    assert {k: got[k] for k, *_ in rows} == {"long_refusal": "refusal", "short_echo": "echo", "many_echoes": "echo", "echo_then_answer": None}


def test_terminal_contexts_on_held_out_ends(spark):
    """Fitted on half of the answers: whole texts of the other half may end, texts cut inside a sentence may not."""
    t = spark.read.parquet("/root/testdata/sf0.01/answer_fixtures.parquet").where("length(answer) > 40").select("answer").distinct().toPandas()["answer"]
    texts = sorted(x for x in map(pairs.content_of, t) if x.endswith(("。", ".")) and not pairs.is_refusal(x))
    model = pairs.TerminalContexts(texts[::2])
    whole = [x.rstrip("。. ") for x in texts[1::2]]
    cuts = [x[:k] for x in whole for k in (len(x) // 2, len(x) * 3 // 4) if x[k - 1] not in "。. " and x[k] not in "。. "]
    assert sum(model.odds(x) >= pairs.LEAST_ODDS for x in whole) >= 0.97 * len(whole)
    assert sum(model.odds(x) < pairs.LEAST_ODDS for x in cuts) >= 0.95 * len(cuts)
