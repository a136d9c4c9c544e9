"""Problem 3: personal details in free text, by a skip-chain conditional random field.

Candidate spans come from shapes (addresses, numbers, mail addresses, names next to words that go with
names). They are the nodes of a field over each document: unary potentials from their shape and the words
around them, chain potentials between neighbours, and skip potentials between spans that are the same or
similar text, however far apart. Loopy max-product messages decide all labels of a document together, so a
name that is introduced once is also found where nothing introduces it.

Weights start from a documented prior and are fitted on a bounded sample of candidates that their context
labels beyond doubt (a telling label before a sound shape, or a word that rules the shape out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import FULL, HALF

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"<{k.upper()}>" for k in KINDS}
#: Bounds of the sample that the weights are fitted on.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 4000
_WIDTH = str.maketrans(FULL, HALF)

# Frequent Chinese surnames, single and compound.
SURNAMES = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷"
    "钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂丛焦向柳邢路岳齐沿梅莫庄辛管祝左涂谷祁时舒耿牟卜詹关苗凌费纪靳盛童欧甄项曲成游阳裴席卫查屈鲍位覃霍翁隋植甘景薄单包司柏宁柯阮桂闵解强柴华车冉房边辜吉饶刁瞿戚丘古米池滕晋苑邬臧畅宫来嵺苟全褚廉简娄盖符奚木穆党燕郎邸冀谈姬屠连郜晏栾郁商蒙计喻揭窦迟宇敖糜鄢冷卓花仇艾蓝都巩稽井练仲乐虞卞封竺冼原官衣楚佟栗匡宗应台巫鞠僧桑荆谌银扬明沙薄伏岑习胥保和蔺骆缪闻"
)
COMPOUND = "欧阳|司徒|司马|上官|诸葛|东方|皇甫|尉迟|公孙|令狐|慕容|夏侯|轩辕|长孙|宇文|南宫|独孤|端木|百里|呼延"
# Characters of role and common words that look like a surname and a given name.
NOT_NAMES = re.compile(
    "^(同学|老师|导师|助教|学长|标注|评审|答辩|课题|实验|产品|数据|外部|新成|合作|值班|同组|于是|于此|于出|方法|方案|方面|高清|常见|成对|成功|时间|时候|和同|和预|和质|关于|管理|明确|明显|全部|单独|单侧|单卡|包括|计划|解释|来自|应当|原因|路线|强调|安排|文档|文本|白名|项目|简历|连续|谈到|金额)"
)
_NAME_END = r"(?=$|[，。,.;；、！!？?（(）)\s：:]|同学|老师|教授|博士|先生|女士|师兄|师姐|学长|学姐|负责|整理|分工|来自|带我|带领|当时|完成|一起|记录|指导|提供|接手|共同|协助|说|是)"
_SUR = f"(?:{COMPOUND}|[{SURNAMES}])"
NAME_ZH = (
    ("label", re.compile(rf"(?:姓名|申请人|联系人|推荐人|负责人姓名|报名人|考生|学生姓名|签名|署名|作者)\s*[:：是为]\s*({_SUR}\s?[一-鿿]\s?[一-鿿]?){_NAME_END}")),
    ("self", re.compile(rf"(?:我叫|我的名字(?:是|叫)|本人|名叫|我是)({_SUR}[一-鿿]{{1,2}}){_NAME_END}")),
    ("verb", re.compile(rf"(?:由|换成|感谢|多亏|我和|我跟|我与|联系|请教|找到|交给|委托)({_SUR}[一-鿿]{{1,2}}?)(?=同学|老师|教授|博士|先生|女士|师兄|师姐|学长|学姐|负责|整理|分工|带我|带领|当时|完成|一起|记录|指导|提供|接手|共同|协助)")),
    ("title", re.compile(rf"(?:^|(?<=[，。,.;；、！!？?\s）)]))({_SUR}[一-鿿]{{1,2}}?)(?=\s*[（(](?:组长|队长|导师|老师|同学|学生|助教|负责人|男|女)[）)]|同学(?:负责|说|提出|完成)|老师(?:当时|说|指导))")),
)
_CAP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
NAME_EN = re.compile(rf"(?<![\w.@-])([{_CAP}][{_LOW}'’-]+(?: [{_CAP}]\.)? [{_CAP}][{_LOW}'’]+(?:-[{_CAP}][{_LOW}]+)?)(?![0-9A-Za-z_@])")
# Words before and after English names, words that are no part of a name.
EN_LEFT = re.compile(r"(?:\bname(?: is|:)|\bcalled|\bworked with|\bthanks to|\bLater,?|\bDr\.?|\bProf\.?|\bMr\.?|\bMs\.?|\bMrs\.?|\b(?:by|with|from|and|ask|asked|met|contact|applicant:?|referee:?|author:?|signed:?))\s*$", re.I)
EN_RIGHT = re.compile(r"^\s*(?:took over|checked|and I\b|on the draft|for the (?:hint|help)|helped|said|wrote|joined|led|reviewed|suggested|agreed|,? who\b)", re.I)
EN_STOP = frozenset(
    "later earlier today the a an and or of to in on at for with from by is was were be this that these those we i you he she they it my our your their his her its next then when while under over after before because facing given one first second third in short section every sorry please thank what which how why who where if not no yes only also may can will would should could some many more most newcomers street road lane drive avenue court place way apt unit suite dr prof mr ms mrs question answer".split()
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Drive|Avenue|Ave|Boulevard|Blvd|Way|Court|Place|Close|Terrace|Square|Crescent)"
SHAPES = (
    ("email", "plain", re.compile(r"(?:mailto:)?[A-Za-z0-9][\w.+-]*\s?@\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", re.A)),
    ("email", "spelt", re.compile(r"(?:mailto:)?[A-Za-z0-9][\w.+-]*\s*(?:\(at\)|\[at\]|\{at\}|(?<=\w)\s+at\s+)\s*[A-Za-z0-9-]+(?:\s*(?:\.|\(dot\)|\[dot\]|\s+dot\s+)\s*[A-Za-z]{2,})+", re.A | re.I)),
    ("id_number", "dated", re.compile(r"(?<![\dA-Za-z])\d{6}[ -]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx](?![\dA-Za-z])")),
    ("id_number", "eighteen", re.compile(r"(?<![\dA-Za-z])\d{17}[\dXx](?![\dA-Za-z])")),
    ("phone", "country", re.compile(r"(?<![0-9A-Za-z+])(?:\+|00)\d{1,3}[ -]?(?:\d[ -]?){8,11}(?![\d-])")),
    ("phone", "area", re.compile(r"(?<![0-9A-Za-z(])(?:\(\d{2,4}\) ?\d{3,4}-?\d{4}|0\d{2,3}-\d{7,8}|\d{3}-\d{3}-\d{4})(?![\d-])")),
    ("phone", "grouped", re.compile(r"(?<![0-9A-Za-z.-])1[3-9]\d([ .-])\d{4}\1\d{4}(?![\d-])")),
    ("phone", "mobile", re.compile(r"(?<![\dA-Za-z.-])1[3-9]\d{9}(?![\dA-Za-z-])")),
    ("id_number", "student", re.compile(r"(?<![\dA-Za-z-])(?:[A-Z]{1,3}(?:19|20)\d{2}-\d{4,6}|[A-Z]{2}\d{8}|(?:19|20)\d{8})(?![\dA-Za-z-])")),
    ("address", "zh", re.compile(r"(?:[一-鿿]{2,4}[省市区县镇])*[一-鿿]{2,3}?(?:大道|路|街|巷|胡同|弄)\s*\d+\s*号(?:\s*\d+\s*(?:号楼|栋|幢|座|单元|室|层|楼))*")),
    ("address", "en", re.compile(rf"(?<![0-9A-Za-z-])\d{{1,5}} (?:[A-Z][\w'-]+ ){{1,3}}{_STREET}\b(?:\.(?=,))?(?:, (?:Apt|Unit|Suite|Flat|Room|#)\.? ?\w+)?(?:, [A-Z][a-z]+)?")),
)
# Words around candidates, by what they speak for.
SPEAKS_FOR = {
    "email": re.compile(r"邮箱|邮件|邮址|联系方式|发到|mail|reach|remarks|notes came", re.I),
    "phone": re.compile(r"电话|手机|联系|拨|可以打|留了|致电|phone|tel\b|mobile|call|reach|\bleft\b|number", re.I),
    "id_number": re.compile(r"身份证|证件|学号|护照|准考证|identity|\bid\b|student (?:id|no|number)|passport", re.I),
    "address": re.compile(r"住在|住址|地址|寄到|寄往|地点|address|\blive|post the|send .* to|near", re.I),
}
SPEAKS_AGAINST = re.compile(r"序号|日志|校验|提交号|版本号|流水号|订单|哈希|编号为|checksum|\brun\b|\blog\b|commit|build|version|hash|order no", re.I)
_LEFT, _RIGHT = 16, 10
_BORDER = re.compile(r"[。！？\n]|[.!?] (?=[A-Z])")

#: The prior: weight of each feature for the label it is named with, against "no personal detail".
PRIOR = {
    "email:bias": 3.0, "email:plain": 2.0, "email:spelt": 1.0, "email:for": 1.0, "email:against": -1.0,
    "phone:bias": 0.0, "phone:country": 2.0, "phone:area": 1.5, "phone:grouped": 1.5, "phone:mobile": 1.0, "phone:for": 2.0, "phone:against": -5.0,
    "id_number:bias": 0.0, "id_number:dated": 2.0, "id_number:eighteen": -1.0, "id_number:student": -0.5, "id_number:for": 3.0, "id_number:against": -5.0,
    "address:bias": 2.0, "address:zh": 1.0, "address:en": 1.0, "address:for": 1.0, "address:against": 0.0,
    "name:bias": -1.0, "name:label": 4.0, "name:self": 3.0, "name:verb": 3.0, "name:title": 3.0, "name:cap": -0.5, "name:left": 2.0, "name:right": 2.0, "name:repeat": 0.0, "name:part": 0.9, "name:not": -8.0,
    "skip:same": 2.5, "skip:similar": 1.5, "chain:": 0.2,
}
# skip: potentials for equal labels of the same text and of texts that share a part; chain: of two details in a row.
#: Labelled pairs that the prior of a skip potential counts for.
PRIOR_PAIRS = 40


@dataclass
class Span:
    start: int
    end: int
    text: str
    kinds: dict[str, list[str]] = field(default_factory=dict)


def candidates(text: str) -> list[Span]:
    """Candidate spans in order, without overlaps; ``kinds`` holds the features of each possible label."""
    wide = text.translate(_WIDTH)
    found: list[Span] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str, features: list[str]) -> None:
        if start >= end or any(a < end and start < b for a, b in taken):
            return
        span = Span(start, end, wide[start:end])
        left = _BORDER.split(wide[max(0, start - _LEFT) : start])[-1]
        right = _BORDER.split(wide[end : end + _RIGHT])[0]
        about = f"{left} {right}"
        features = ["bias", *features]
        if kind in SPEAKS_FOR and (SPEAKS_FOR[kind].search(left) or kind == "id_number" and SPEAKS_FOR[kind].search(right)):
            features.append("for")
        if kind != "name" and SPEAKS_AGAINST.search(about) and not (kind in SPEAKS_FOR and SPEAKS_FOR[kind].search(left[-6:])):
            features.append("against")
        span.kinds[kind] = [f"{kind}:{f}" for f in features]
        taken.append((start, end))
        found.append(span)

    for kind, shape, pattern in SHAPES:
        for m in pattern.finditer(wide):
            start, end = m.span()
            if kind == "address" and shape == "zh":
                got = re.match(r"[^省市区县镇]*?(?:住在|寄到|寄往|位于|地址[:：是为]?|搬到|地点在|在|到)(?=.{3})", m.group())
                start += got.end() if got else 0
            end = start + len(wide[start:end].rstrip(" -"))
            add(start, end, kind, [shape])
    for how, pattern in NAME_ZH:
        for m in pattern.finditer(wide):
            name = m.group(1).rstrip()
            add(m.start(1), m.start(1) + len(name), "name", [how, *(["not"] if NOT_NAMES.search(name) else [])])
    capitals = None
    at = 0
    while m := NAME_EN.search(wide, at):
        parts = [p.lower().strip(".") for p in re.split(r"[ -]", m.group(1))]
        if any(p in EN_STOP for p in parts):
            at = m.start() + len(m.group().split(" ")[0])
            continue
        at = m.end()
        if capitals is None:  # texts in title case tell nothing
            w = re.findall(r"[A-Za-z]+", wide)
            capitals = sum(x[0].isupper() for x in w) > 0.5 * len(w) and len(w) > 8
        features = ["cap"]
        if EN_LEFT.search(wide[max(0, m.start(1) - 24) : m.start(1)]):
            features.append("left")
        if EN_RIGHT.search(wide[m.end(1) : m.end(1) + 24]):
            features.append("right")
        if capitals and len(features) < 3:
            continue
        add(m.start(1), m.end(1), "name", features)
    names = {s.text for s in found if "name" in s.kinds}
    for name in sorted(names):  # the same name elsewhere
        for m in re.finditer(re.escape(name), wide):
            add(m.start(), m.end(), "name", ["repeat"])
    for part in sorted({p for name in names if name[0] < "\u2e80" for p in _parts(name)}):  # and a part of it alone
        for m in re.finditer(rf"(?<![\w.@-]){re.escape(part.capitalize())}(?![\w@])", wide):
            add(m.start(), m.end(), "name", ["part"])
    return sorted(found, key=lambda s: s.start)


def _core(text: str) -> str:
    return re.sub(r"[\W_]", "", text).lower()


def _parts(name: str) -> set[str]:
    """Parts by which a name may be meant: words of a spaced name, the given name of another."""
    if name[:1] < "\u2e80":
        return {p for p in re.split(r"[ -]", name.lower()) if len(p) > 2 and p.isalpha() and p not in EN_STOP}
    return {name, name[-2:]}


def skip_edges(spans: list[Span]) -> dict[tuple[int, int], str]:
    """Pairs of spans that share potentials, at any distance: ``same`` text but for form, or names with a common
    part (``similar``). A chain through all places of one text or part keeps them linear."""
    edges: dict[tuple[int, int], str] = {}
    by: dict[tuple[str, str], list[int]] = {}
    for i, s in enumerate(spans):
        by.setdefault(("same", _core(s.text)), []).append(i)
        if "name" in s.kinds:
            for part in _parts(s.text):
                by.setdefault(("similar", part), []).append(i)
    for (kind, _), places in by.items():
        for a, b in zip(places, places[1:]):
            if kind == "same" or edges.get((a, b)) is None:
                edges[a, b] = kind
    return edges


def label(spans: list[Span], weights: dict[str, float]) -> list[str | None]:
    """The labels of the spans: damped max-product messages over chain and skip edges until they settle; loops that
    do not are left after 50 rounds and 4 for each span."""
    unary = [{None: 0.0} | {k: sum(weights.get(f, 0.0) for f in fs) for k, fs in s.kinds.items()} for s in spans]
    n = len(spans)
    edges = dict.fromkeys(((i, i + 1) for i in range(n - 1)), 0.0)
    edges |= {e: weights.get(f"skip:{kind}", 0.0) for e, kind in skip_edges(spans).items()} if n > 1 else {}
    chain = weights.get("chain:", 0.0)
    if not edges:
        return [max(u, key=lambda k: u[k]) for u in unary]

    def pair(e: tuple[int, int], x: str | None, y: str | None) -> float:
        skip = edges[e]
        return (skip if x == y else 0.0) + (chain if e[1] == e[0] + 1 and x and y else 0.0)

    around: list[list[int]] = [[] for _ in range(n)]
    message: dict[tuple[int, int], dict[str | None, float]] = {}
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
        message[a, b] = dict.fromkeys(unary[b], 0.0)
        message[b, a] = dict.fromkeys(unary[a], 0.0)
    for _ in range(50 + 4 * n):
        change = 0.0
        for a, b in list(message):
            e = (a, b) if (a, b) in edges else (b, a)
            base = {x: unary[a][x] + sum(message[c, a][x] for c in around[a] if c != b) for x in unary[a]}
            new = {y: max(base[x] + (pair(e, x, y) if e == (a, b) else pair(e, y, x)) for x in base) for y in unary[b]}
            top = max(new.values())
            for y, v in new.items():
                v = 0.5 * (v - top) + 0.5 * message[a, b][y]  # damped
                change = max(change, abs(v - message[a, b][y]))
                message[a, b][y] = v
        if change < 1e-3:
            break
    beliefs = [{x: u[x] + sum(message[c, i][x] for c in around[i]) for x in u} for i, u in enumerate(unary)]
    return [max(b, key=lambda k: b[k]) for b in beliefs]


def find(text: str | None, weights: dict[str, float] = PRIOR) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each personal detail."""
    spans = candidates(text) if text else []
    return [(s.start, s.end, k) for s, k in zip(spans, label(spans, weights)) if k]


def redact(text: str | None, weights: dict[str, float] = PRIOR) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for a, b, k in find(text, weights):
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join(out) + text[at:]


def fit(texts: list[str], pull: float = 0.05, steps: int = 120, rate: float = 0.5) -> dict[str, float]:
    """Weights by gradient ascent of the pseudo-likelihood of self-labelled candidates, held near the prior; skip
    potentials are the log odds that self-labelled ends of their edges agree."""
    rows: list[tuple[list[str], float]] = []
    agree = {k: [PRIOR_PAIRS / (1 + np.exp(sign * PRIOR[f"skip:{k}"])) for sign in (1, -1)] for k in ("same", "similar")}
    for t in texts:
        spans = candidates(t)
        known: dict[int, float] = {}
        for i, s in enumerate(spans):
            for fs in s.kinds.values():
                told = {f.split(":")[1] for f in fs}
                if "against" in told or "not" in told:
                    known[i] = 0.0
                elif told & {"for", "label", "self"} and "eighteen" not in told:
                    known[i] = 1.0
                if i in known:
                    rows.append((fs, known[i]))
        for (a, b), kind in skip_edges(spans).items():
            if a in known and b in known:
                agree[kind][known[a] == known[b]] += 1
    names = list(PRIOR)
    at = {f: i for i, f in enumerate(names)}
    prior = np.array([PRIOR[f] for f in names])
    if not rows:
        return dict(PRIOR)
    x = np.zeros((len(rows), len(names)))
    y = np.array([v for _, v in rows])
    for i, (fs, _) in enumerate(rows):
        x[i, [at[f] for f in fs]] = 1
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += rate * (x.T @ (y - p) / len(rows) - pull * (w - prior))
    return dict(zip(names, w.tolist())) | {f"skip:{k}": float(np.log(yes / no)) for k, (no, yes) in agree.items()}


def without_edges(weights: dict[str, float]) -> dict[str, float]:
    """The same weights, each span for itself."""
    return {f: 0.0 if f.startswith(("skip:", "chain:")) else w for f, w in weights.items()}


def may_hold(text: Column) -> Column:
    """Whether a text can hold a candidate at all; JVM-side, without misses of ``candidates``."""
    # As in ``candidates`` widths are folded; each part is wider than its shape.
    text = F.translate(text, FULL, HALF)
    blank = r"[\s\p{Z}\x1c-\x1f\x85]*"
    patterns = (
        r"\p{Nd}[\p{Nd} .()+\-]{6,}\p{Nd}|@|[\[({] ?(?i:at) ?[\])}]|\w\s+(?i:at)\s+\S|[道路街巷同弄]" + blank + r"\p{Nd}+" + blank
        + r"号|\p{Nd} [A-Z][^ ]+ |[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+(?: [A-ZÀ-ÖØ-Þ]\.)? [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]|[A-Z]{1,3}\p{Nd}{4}"
    )
    names = f"姓名|申请人|联系人|推荐人|报名人|考生|签名|署名|作者|我叫|我的名字|名叫|本人|我是|(?:由|换成|感谢|多亏|我和|我跟|我与|联系|请教|找到|交给|委托)(?:{COMPOUND}|[{SURNAMES}])|[（(](?:组长|队长|导师|老师|同学|学生|助教|负责人|男|女)[）)]|同学(?:负责|说|提出|完成)|老师(?:当时|说|指导)"
    return text.rlike(patterns) | text.rlike(names)


def fit_weights(df: DataFrame, text: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, float]:
    """Fit on the texts of at most ``rows`` rows, the first by hash, and ``chars`` characters of each."""
    t = F.col(text)
    sample = df.where(t.isNotNull()).select(F.substring(t, 1, chars).alias("t"), F.xxhash64(t).alias("h")).orderBy("h", "t").limit(rows)
    return fit(sorted({r["t"] for r in sample.collect()}))


def personal_details(df: DataFrame, key: str, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, kind, ``details``): each kind of personal detail in a record, with how many there are in its
    text. Repeated rows count once, rows of one key with different texts add up; null and empty texts hold
    none; texts are read whole; extra columns are ignored; an empty table gives an empty one."""
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    weights = fit_weights(rows, "t") if weights is None else weights
    some = rows.where(F.col("k").isNotNull() & may_hold(F.col("t"))).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, kind) for k, t in zip(b["k"], b["t"]) for _, _, kind in find(t, weights)]
            yield pd.DataFrame(out, columns=["k", "kind"])

    return some.mapInPandas(run, "k string, kind string").groupBy("k", "kind").agg(F.count("*").alias("details")).withColumnRenamed("k", key)


def field_effect(df: DataFrame, text: str, weights: dict[str, float] | None = None) -> DataFrame:
    """One row: ``texts`` with candidates, ``spans`` labelled, and ``settled_by_edges``: spans whose label the edges of
    the field change, either way. Each text counts once."""
    rows = df.select(F.col(text).cast("string").alias("t")).distinct()
    weights = fit_weights(rows, "t") if weights is None else weights
    alone = without_edges(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = []
            for t in b["t"]:
                spans = candidates(t)
                both = list(zip(label(spans, weights), label(spans, alone)))
                counts.append((int(bool(spans)), sum(x is not None for x, _ in both), sum(x != y for x, y in both)))
            yield pd.DataFrame(counts, columns=["texts", "spans", "settled_by_edges"])

    found = rows.where(F.coalesce(may_hold(F.col("t")), F.lit(False))).mapInPandas(run, "texts long, spans long, settled_by_edges long")
    return found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in found.columns))


def redacted(df: DataFrame, text: str, out: str = "redacted", weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with a column ``out``: the text with typed placeholders for personal details and the rest
    unchanged. A column of that name must not exist yet. Null stays null. Rows and their order within
    partitions stay; texts without candidates never leave the JVM."""
    if out in df.columns:
        raise ValueError(f"column {out!r} is there already")
    weights = fit_weights(df, text) if weights is None else weights
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[out] = [redact(t, weights) for t in b[text]]
            yield b

    hit = F.coalesce(may_hold(F.col(text)), F.lit(False))
    return df.where(hit).mapInPandas(run, schema).unionByName(df.where(~hit).withColumn(out, F.col(text)))
