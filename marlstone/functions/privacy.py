"""The privacy gates: four separate rule sets, each with its own categories and placeholders.

Word characters and digits are those of Unicode, as the rules are stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the ingestion gate, in the order in which they are applied.
W, D = r"\p{L}\p{N}_", r"\p{Nd}"
GATE = {
    "email": rf"(?i)(?<![{W}.-])[{W}.+-]+@[{W}.-]+\.[a-z]{{2,}}(?![{W}.-])",
    "phone": rf"(?<!{D})1[3-9]{D}{{9}}(?!{D})",
    "id_card": rf"(?<!{D}){D}{{17}}[{D}Xx](?!{D})",
    "student_id": r"(?i)(?:学号|student[ _-]?id)\s*[:：=]?\s*[a-z0-9_-]{5,32}",
    "wechat": r"(?i)(?:微信号?|wechat)\s*[:：=]\s*[a-z][-_a-z0-9]{5,19}",
    "qq": rf"(?i)(?<![{W}])qq\s*[:：=]\s*[1-9]{D}{{4,11}}(?![{W}])",
    "name_label": r"(?:姓名|申请人|推荐人)\s*[:：]\s*[一-鿿·]{2,12}",
    "secret": rf"(?i)(?:(?<![{W}])(?:api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret)(?![{W}])\s*[:=]\s*[^\s,;]{{4,}}|(?:密码|口令|解压码)\s*[:：=]\s*[a-z0-9_!@#$%^&*.+-]{{4,128}})",
}
GATE_LABELS = {k: f"<redacted:{'name' if k == 'name_label' else k}>" for k in GATE}
PATH_RISK_TERMS = ("身份证", "成绩单", "排名", "推荐信", "个人陈述", "申请表", "简历", "聊天记录", "导师私聊")
INJECTION = (
    r"(?i)ignore\s+(?:all\s+)?previous\s+instructions", r"(?i)reveal\s+(?:the\s+)?system\s+prompt",
    "忽略(?:以上|之前|所有)指令", "泄露(?:系统提示|密钥|其他用户)", "执行(?:命令|删除工具|任意工具)",
)
LEVELS = ("public", "low", "medium", "high")

# Categories of the curation scan.
CURATION = {
    "name": (r"(?i)(?:学生姓名|申请人|姓名|名字|candidate\s*name|name)(?:\s*[:：]\s*|\s+)[^\s,，;；]{2,40}",),
    "school": (
        r"(?i)(?:本科院校|毕业院校|就读学校|学校|院校|university|college)\s*[:：]\s*[^\n,，;；]{2,80}",
        "[一-鿿]{2,30}(?:大学|学院)", r"(?i)(?<![\p{L}\p{N}_])(?:[A-Z][A-Z&.'-]*\s+){0,5}(?:University|College)(?![\p{L}\p{N}_])",
    ),
    "student_id": (r"(?i)(?:学号|student\s*id)\s*[:：]?\s*[A-Z0-9-]{6,32}",),
    "email": (r"(?i)(?<![\p{L}\p{N}_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?![\p{L}\p{N}_])",),
    "phone": (rf"(?<!{D})(?:\+?86[-\s]?)?1[3-9](?:[-\s]?{D}){{9}}(?!{D})", rf"(?<!{D})0{D}{{2,3}}[-\s]?{D}{{7,8}}(?!{D})"),
    "address": (r"(?i)(?:家庭住址|通讯地址|住址|地址|address)(?:\s*[:：]\s*|\s+)[^\n,，;；]{3,120}",),
    "supervisor": (r"(?i)(?:导师|指导教师|supervisor|advisor)(?:\s*[:：]\s*|\s+)[^\n,，;；]{2,60}",),
    "absolute_path": (r"(?i)(?:[A-Z]:[\\/]+|\\\\+)[^\s\"'<>|]+", r"(?<![:/])/(?:[^/\s\"'<>|]+/)+[^/\s\"'<>|]*"),
    "password_hint": (r"(?i)(?:解压密码|访问密码|文件密码|密码提示|提取码|密码|口令|password|passcode)\s*(?:is|为|[:：=])\s*[^\s,，;；]{1,120}",),
    "qr_text": (r"(?i)(?:二维码(?:内容|文本)?|QR\s*(?:code|text)?)\s*[:：]?\s*[^\n]{0,200}",),
    "organization_label": (r"(?i)(?:单位|机构|组织|工作单位|organization)(?:\s*[:：]\s*|\s+)[^\n,，;；]{2,120}",),
    "copyright_label": (r"(?i)(?:©|(?<![\p{L}\p{N}_])copyright(?![\p{L}\p{N}_])|版权所有)[^\n]{0,160}",),
    "watermark_label": (r"(?i)(?:水印|watermark)\s*[:：]?\s*[^\n]{0,160}",),
    "prompt_injection": (
        r"(?i)(?:ignore|disregard|override).{0,40}(?:previous|prior|system).{0,30}(?:instructions?|prompts?)",
        "(?:忽略|无视|覆盖|绕过).{0,16}(?:之前|先前|系统).{0,12}(?:指令|提示词)", "(?:输出|泄露|展示).{0,12}(?:原始材料|系统提示词|隐私数据|完整原文)",
    ),
}
SIGNALS = (
    r"(?i)(?:(?:来自|籍贯|户籍|生源地|常住).{0,12}(?:省|市|县|区)|\bfrom\b.{0,24}\b(?:province|city|county|district)\b)",
    rf"(?i)(?:(?:专业|年级|班级|综合)?排名\s*(?:第)?\s*{D}+|\branked?\s*{D}+)",
    r"(?i)(?:唯一|仅有|独一|\b(?:only|unique|sole)\b)",
    rf"(?i)(?:第?{D}{{2,4}}届|该届|年级|班级|\bcohort\b|\bclass\s+of\s+{D}{{4}}\b)",
    r"(?i)(?:获奖|竞赛|奖项|保送|录取|\b(?:award|winner|admitted|enrolled)[\p{L}\p{N}_]*\b)",
)
DIRECT_IDENTITY = ("name", "school", "student_id", "email", "phone", "address", "supervisor", "absolute_path")
FAIL_CLOSED = ("password_hint", "qr_text", "organization_label", "copyright_label", "watermark_label", "prompt_injection", "reidentification_combo")
UNSAFE = "[REDACTED_UNSAFE_BLOCK]"


def gate_counts(text: Column) -> Column:
    """Map of category to number of findings, for categories with any."""
    entries = [F.struct(F.lit(k).alias("k"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias("n")) for k, p in GATE.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["n"] > 0))


def injected(text: Column) -> Column:
    out = F.lit(False)
    for p in INJECTION:
        out = out | text.rlike(p)
    return out


def path_terms(path: Column) -> Column:
    found = F.array_compact(F.array(*(F.when(path.contains(t), F.lit(t)) for t in PATH_RISK_TERMS)))
    return F.array_sort(found)


def recommended(counts: Column, terms: Column) -> Column:
    high = F.map_contains_key(counts, F.lit("id_card")) | F.map_contains_key(counts, F.lit("secret")) | (F.size(terms) > 0)
    return F.when(high, F.lit("high")).when(F.size(counts) > 0, F.lit("medium")).otherwise(F.lit("public"))


def level(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, n in enumerate(LEVELS):
        out = F.when(name == n, F.lit(i)).otherwise(out)
    return out


def ingestion_decision(declared: Column, suggested: Column, injection: Column, public_mode: bool) -> Column:
    """accept, confirm or reject, by the greater of the declared and the suggested sensitivity."""
    top = F.greatest(level(declared), level(suggested))
    rules = F.when(top == 3, F.lit("reject")).when((top == 2) | injection, F.lit("confirm")).otherwise(F.lit("accept"))
    return F.when((top > 0) | injection, F.lit("reject")).otherwise(rules) if public_mode else rules


def redact(text: Column) -> Column:
    """All categories replaced one after the other; later ones see the earlier ones' placeholders."""
    for k, p in GATE.items():
        text = F.regexp_replace(text, p, GATE_LABELS[k])
    return text


def replace_terms(text: Column, terms: list[str], by: str = "[REDACTED]") -> Column:
    """Identity terms of two characters or more replaced literally."""
    for t in terms:
        if len(t.strip()) >= 2:
            text = F.replace(text, F.lit(t.strip()), F.lit(by))
    return text


def curation_hits(text: Column) -> Column:
    """Categories of the curation scan that a text hits, in order, with the combination rule last."""
    def any_of(patterns: tuple[str, ...]) -> Column:
        out = text.rlike(patterns[0])
        for p in patterns[1:]:
            out = out | text.rlike(p)
        return out

    hits = F.array_compact(F.array(*(F.when(any_of(p), F.lit(k)) for k, p in CURATION.items())))
    signals = sum((text.rlike(p).cast("int") for p in SIGNALS[1:]), text.rlike(SIGNALS[0]).cast("int"))
    direct = F.size(F.array_intersect(hits, F.array(*map(F.lit, DIRECT_IDENTITY))))
    return F.when((signals >= 3) | (direct >= 3), F.array_append(hits, F.lit("reidentification_combo"))).otherwise(hits)


def curation_unsafe(hits: Column) -> Column:
    return F.arrays_overlap(hits, F.array(*map(F.lit, FAIL_CLOSED)))


def anonymized(df: DataFrame, text: str, out: str = "anonymized") -> DataFrame:
    """Each hit category replaced; a text that is unsafe, or still hit afterwards, becomes a placeholder as a
    whole. ``_hits``, ``_clean`` and ``_left`` must not be columns of ``df``."""
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), F.lit(f"[REDACTED_{k.upper()}]").alias("r")) for k, ps in CURATION.items() for p in ps))
    df = df.withColumn("_hits", curation_hits(F.col(text)))
    wanted = F.filter(steps, lambda x: F.array_contains(F.col("_hits"), x["k"]))
    df = df.withColumn("_clean", F.aggregate(wanted, F.col(text), lambda acc, x: F.regexp_replace(acc, x["p"], x["r"])))
    df = df.withColumn("_left", F.when(F.size("_hits") > 0, F.size(curation_hits(F.col("_clean")))).otherwise(F.lit(0)))
    final = F.when(curation_unsafe(F.col("_hits")) | (F.col("_left") > 0), F.lit(UNSAFE)).otherwise(F.col("_clean"))
    return df.withColumn(out, final).drop("_hits", "_clean", "_left")


# Public asset scan.
ASSET_PATH = r"(?i)(?:[A-Z]:[\\/](?:Users|home)[\\/]|/(?:home|Users)/)[^\s\"']+"
ASSET_CREDENTIAL = r"(?i)(?:access[_-]?token|api[_-]?key|password)"
ASSET_EMAIL = r"[^\s@]+@[^\s@]+\.[^\s@]+"


def asset_findings(text: Column) -> Column:
    """Number of paths, credential words and mail addresses."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return count(ASSET_PATH) + count(ASSET_CREDENTIAL) + count(ASSET_EMAIL)


def summary(text: Column, keep: int = 16) -> Column:
    """Length and a short digest of a text, which may be logged instead of it."""
    return F.struct(F.length(text).alias("length"), F.substring(F.sha2(text, 256), 1, keep).alias("digest"))
