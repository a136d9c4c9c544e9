"""Problem 1: broken question-answer pairs.

Copies of the question are found by compressing each answer with its question as a raw zstandard
dictionary; languages and refusals by dictionaries; answers that stop early by a terminal-context
model, the log odds of the contexts around the end of an answer at sentence ends against places inside
sentences, and by points that are announced and missing.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import squeeze

#: Bounds of the sample that the terminal-context model is fitted on: rows, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 2000
#: An answer is looked at as a copy if the question as dictionary leaves at most this share of its size, or so many bytes.
COPY_RATIO, COPY_REST = 0.55, 24
#: Cells of the hashed contexts; least log odds that a text without a stop may end where it does.
CONTEXTS, LEAST_ODDS = 1 << 18, 0.0

# Markers, labels and placeholders.
CITATION = re.compile(r"[\[【(]\s*[Ss]\s*\d+\s*[\]】)]")
INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
LABEL = re.compile(r"^\s*(答案|回答|作答|答|参考答案|answer|response|reply|a)\s*[:：]\s*", re.I)
PLACEHOLDERS = frozenset(
    "todo tbd tba na null none nil nan undefined empty pending placeholder xxx 待补充 待填 待填写 待定 待完善 暂无 暂缺 无 略 同上 空 未填写 未作答 没有 此处待补".split()
)

# The refusal dictionary. Declining phrases, and phrases that go with them.
DECLINE_ZH = re.compile(
    "恕难|恕不|(无法|不能|不便|没法|难以|拒绝|不予|无权|没有权限|不方便|不宜|不就|就不)(再)?(回答|作答|解答|提供|给出|就此|讨论|展开|评论|协助|帮助|谈论|回应|处理)"
    "|(题|问题).{0,3}(先)?跳过|无从(判断|回答|作答)|超出了?(我)?的?.{0,6}范围|不足以.{0,6}(作答|回答|判断|支持)"
    "|没有找到.{0,4}(依据|证据|资料)|(查不到|找不到)|不能展开|不属于我的"
)
FILLER_ZH = re.compile(
    "^(抱歉|对不起|不好意思|很遗憾|遗憾的是|坦率地说|说实话|非常抱歉|出于.{0,6}考虑|关于.{0,60}|因此|所以)$"
    "|换(一)?个话题|请(咨询|参考|联系|以).{0,14}|建议.{0,16}|请谅解|敬请"
)
DECLINE_EN = re.compile(
    r"\b(can ?not|can't|cannot|unable to|not able to|won't|will not|would not|must not|not allowed to|rather not|prefer not to)\b.{0,24}\b(help|answer|comment|assist|discuss|respond|provide|share|say|do that)"
    r"|\b(must|have to|will) decline\b|\bi decline\b|\boutside (of )?(what i can|my)\b|\bmy role does not\b|\bnot enough (material|information|evidence) to\b"
    r"|\bno (reliable )?(evidence|source|material) was found\b|\bno answer is given\b|\brefuse to\b|\bcan't help\b",
    re.I,
)
FILLER_EN = re.compile(
    r"^(so|but|and|sorry|i'?m sorry|i am sorry|apologies|my apologies|unfortunately|to be frank|frankly|regrettably|about .{0,80})$"
    r"|^(so |but |and )?(please )?(try|ask|see|consult|contact|check|refer to)\b.{0,50}$",
    re.I,
)

# Language dictionaries of frequent function words, for languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are this be by or from at which we you not have an had they were but can will how would if my their its when where who what why".split(),
    "es": "el la los las de que y en un una por con para como se del al lo más pero sus le ya este sí porque cuando muy sin sobre también primero después final dejo".split(),
    "fr": "le la les de des et un une est que dans pour qui sur avec ne pas au par plus ce il je vous nous mais ou donc comme du en d'abord ensuite enfin j'ai".split(),
    "de": "der die das und ist nicht ein eine zu den mit von auf für im dem sich des als auch es an werden aus er hat dass sie nach bei ich danach schließlich zuerst".split(),
    "pt": "o os as de que e em um uma para com não por mais dos como mas foi ao ele das tem seu sua ou ser quando muito nos já eu também primeiro depois".split(),
    "it": "il lo gli di che e in un una per con non del della sono più anche come ma dal alla nel si dei le questo prima poi infine".split(),
}
_WORD_LANGS: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _WORD_LANGS.setdefault(_w, []).append(_lang)

# Names of languages, for questions that ask for one.
LANGUAGE_NAMES = {
    "英文": "en", "英语": "en", "english": "en", "中文": "zh", "汉语": "zh", "chinese": "zh", "mandarin": "zh", "日文": "ja", "日语": "ja", "japanese": "ja",
    "法文": "fr", "法语": "fr", "french": "fr", "德文": "de", "德语": "de", "german": "de", "西班牙文": "es", "西班牙语": "es", "spanish": "es",
    "韩文": "ko", "韩语": "ko", "korean": "ko", "俄文": "ru", "俄语": "ru", "russian": "ru", "葡萄牙语": "pt", "portuguese": "pt", "意大利语": "it", "italian": "it",
}
_NAMES = "|".join(sorted(LANGUAGE_NAMES, key=len, reverse=True))
ASKED = re.compile(
    rf"(?:用|以|使用|改用|请用)\s*({_NAMES})\s*(?:来)?\s*(?:回答|作答|答复|回复|写|说|表达|撰写)|({_NAMES})\s*(?:作答|回答|答复)|(?:answer|reply|respond|write|written|answered)\b.{{0,20}}\bin\s+({_NAMES})\b",
    re.I,
)

_OPEN, _CLOSE = "(（[【“「『《", ")）]】”」』》"
_TERMINAL = re.compile(r"[。．.!?！？…~～♪][\"'”’)）\]】」』》]*$")
_ELLIPSIS = re.compile(r"\s*(?:…+|\.{3,}|。{3,})[\"'”’)）\]】」』》]*$")
_HANGING = re.compile(r"[,，、;；:：(（\[【“「『《\-—–/]$")
_HAN = re.compile(r"[㐀-鿿]")
_KANA = re.compile(r"[぀-ヿ]")
_HANGUL = re.compile(r"[가-힯]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_ARABIC = re.compile(r"[؀-ۿ]")
_OTHER_SCRIPT = re.compile(r"[가-힯Ѐ-ӿ؀-ۿ]")
_LATIN = re.compile(r"[a-zà-öø-ÿāēīōū']+", re.I)
_SENTENCE = re.compile(r"[^。！？!?\n]*?(?:[。！？!?\n]|\.(?=\s|$))")
_CLAUSE = re.compile(r"[，。,.;；!！?？:：\n]+")

_STOP = re.compile(r"[。．.!?！？…]+[\"'”’)）\]】」』》]*$")
_SENTENCE_END = re.compile(r"[。！？!?\n]+[\"'”’)）\]】」』》]*|\.(?=\s|$)")
# Numerals of announced points, and the ordinals that count them.
NUMERALS = {"两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ORDINALS_ZH, ORDINALS_EN = "一二三四五六七八九十", "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_ORDINALS = {f"第{c}": i for i, c in enumerate(ORDINALS_ZH, 1)} | {w: i for i, w in enumerate(ORDINALS_EN, 1)} | {w + "ly": i for i, w in enumerate(ORDINALS_EN, 1)}
_ORDINAL = re.compile(rf"第[{ORDINALS_ZH}](?=[，,、：:]|点|是)|\b(?:{'|'.join(ORDINALS_EN)})(?:ly)?(?=[,:])", re.I)
_ANNOUNCED = re.compile(
    r"(?:分|有|包括|讲|说)(?:为|成)?(?:以下|如下)?([两二三四五六七八九十]|\d)(?:个|条|大)?(?:点|方面|部分|步|层|条|件事)(?=[。：:，,])"
    r"|\b(two|three|four|five|six|seven|eight|nine|ten|\d) (?:\w+ )?(?:points|parts|steps|reasons|aspects|things)\b",
    re.I,
)
_NEXT_POINT = re.compile(r"(?:[：:，,；;。.\n]|^)\s*(?:(?:[（(]?\d{1,2}[.、)）．]|[①-⑩]|[-*•])|第[一二三四五六七八九十][，,、：:]|(?:first|second|third|fourth|fifth)(?:ly)?[,:])\s*$", re.I)


def content_of(answer: str | None) -> str:
    """The answer without citation markers, invisible characters and blanks around it."""
    return CITATION.sub("", INVISIBLE.sub("", answer or "")).strip()


def language_of(text: str) -> str | None:
    """A language code from scripts and function words, None if there is too little to tell."""
    if text.isascii():
        han = kana = 0
    else:
        han, kana = len(_HAN.findall(text)), len(_KANA.findall(text))
    words = _LATIN.findall(text.lower())
    if _OTHER_SCRIPT.search(text):
        for code, pattern in (("ko", _HANGUL), ("ru", _CYRILLIC), ("ar", _ARABIC)):
            if (n := len(pattern.findall(text))) > 4 and n > han:
                return code
    if kana >= 4 and kana >= 0.1 * (han + kana):
        return "ja"
    if han >= 4 and han >= len(words):
        return "zh"
    if len(words) < 4:
        return None
    votes: dict[str, float] = {}
    for w in words:
        langs = _WORD_LANGS.get(w, ())
        for lang in langs:
            votes[lang] = votes.get(lang, 0) + 1 / len(langs)
    if not votes:
        return None
    best = max(votes, key=lambda k: (votes[k], k))
    return best if votes[best] >= max(2, 0.1 * len(words)) else None


def asked_language(question: str) -> str | None:
    m = ASKED.search(question)
    return LANGUAGE_NAMES[next(g for g in m.groups() if g).lower()] if m else None


def is_empty(content: str) -> bool:
    core = LABEL.sub("", content)
    letters = squeeze(core)
    return not letters or letters in PLACEHOLDERS


def is_refusal(content: str) -> bool:
    """A declining clause, and next to nothing but phrases that go with one."""
    text = content.replace("’", "'").replace("‘", "'")
    zh = bool(_HAN.search(text))
    decline, filler, room = (DECLINE_ZH, FILLER_ZH, 12) if zh else (DECLINE_EN, FILLER_EN, 40)
    if not decline.search(text):
        return False
    other = 0
    for clause in _CLAUSE.split(text):
        clause = clause.strip()
        if clause and not decline.search(clause) and not filler.search(clause):
            other += len(squeeze(clause))
    return other <= room


class CopyMeter:
    """Size of an answer compressed with its question as dictionary, relative to that without."""

    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)
        self.overhead = len(self.plain.compress(b""))

    def ratio(self, question: str, answer: str) -> float:
        """0 for texts that leave COPY_REST bytes or fewer: so short a rest says nothing of its own."""
        q, a = question.encode(), answer.encode()
        if not q or not a:
            return 1.0
        q *= -(-8 // len(q))  # the format wants 8 bytes; a repetition tells nothing new
        given = zstandard.ZstdCompressionDict(q, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        with_q = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=False, write_content_size=False, write_dict_id=False)
        rest = max(0, len(with_q.compress(a)) - self.overhead)
        return 0.0 if rest <= COPY_REST else rest / max(1, len(self.plain.compress(a)) - self.overhead)


def _covered(text: str, grams: set[str], k: int) -> int:
    """Characters of ``text`` that lie in a run of ``k`` or more whose grams are all known."""
    n = at = 0
    for i in range(len(text) - k + 1):
        if text[i : i + k] in grams:
            n += i + k - max(at, i)
            at = i + k
    return n


def is_echo(question: str, answer: str) -> bool:
    """Exact check of a copy: hardly anything in the answer is not of the question, and a large part of
    the question is in it. Both are squeezed texts; linear in their lengths."""
    if question and question == answer:
        return True
    k = 5 if _HAN.search(answer) else 10
    grams_of = lambda t: {t[i : i + k] for i in range(len(t) - k + 1)}
    new = len(answer) - _covered(answer, grams_of(question), k)
    if new > max(3 * k, 0.03 * len(answer)):
        return False
    return _covered(question, grams_of(answer), k) >= max(1, 0.3 * len(question))


def _clauses(sentence: str) -> list[str]:
    return [c.strip() for c in _CLAUSE.split(sentence)]


def contexts_of(sentence: str, words: set[str]) -> list[int]:
    """Hashed contexts of the place where ``sentence`` stops: what comes right before it, how its last clauses
    begin, and both together. Han text by characters, other text by words, the last of which may be cut."""
    clauses = _clauses(sentence)
    last, before = clauses[-1], clauses[-2] if len(clauses) > 1 else ""
    n = min(len(clauses), 4)
    if _HAN.search(last[-4:]) or not last and _HAN.search(before):
        head = last[:3]
        out = [f"s{last[-k:]}" for k in range(1, min(len(last), 8) + 1)]
        out += [f"h{last[:k]}" for k in range(1, 5)]
        out += [f"x{k}{head[:2]}|{last[-k:]}" for k in (1, 2, 3)] + [f"y{head}|{last[-2:]}", f"p{before[:2]}|{head[:2]}", f"q{before[:3]}|{n}", f"r{before[:2]}|{head[:2]}|{last[-2:]}"]
        out += [f"n{n}|{head[:2]}", f"f{clauses[0][:2]}|{n}", f"g{clauses[0][:2]}|{n}|{last[-2:]}", f"l{min(len(last), 20)}", f"m{min(len(last), 20)}|{head[:2]}"]
    else:
        w = last.lower().split()
        known = "".join("1" if x in words else "0" for x in w[-1:])
        t = ["", "", "", "", *w]
        out = [f"k{known}", f"a{t[-1]}", f"b{t[-2]} {t[-1]}", f"c{t[-3]} {t[-2]} {t[-1]}", f"d{t[-2]}|{known}", f"e{t[-3]} {t[-2]}|{known}", f"i{t[-4]} {t[-3]}|{known}"]
        first = w[:2]
        out += [f"u{' '.join(first)}", f"v{first[:1]}|{t[-1]}", f"w{' '.join(first)}|{t[-2]}", f"z{' '.join(first)}|{t[-1]}", f"n{n}|{first[:1]}", f"o{before.lower()[:6]}|{n}|{first[:1]}", f"l{min(len(w), 20)}", f"m{min(len(w), 20)}|{first[:1]}"]
        out += [f"s{last[-k:]}" for k in (1, 2, 3, 4)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (CONTEXTS - 1) for x in out]


def _last_sentence(text: str) -> str:
    """What follows the last sentence end; without a word in it, the last sentence that has one."""
    at = 0
    for m in _SENTENCE_END.finditer(text):
        if m.end() < len(text.rstrip()):
            at = m.end()
    return text[at:].strip()


class TerminalContexts:
    """Log odds that a text may stop after a context, from contexts at ends of sentences and at places inside.

    Sentences that end in a stop give the ends; the same sentences cut at drawn places, at their clause borders
    and shortly before their ends give the places inside. The weights of contexts are fitted by logistic
    regression held near zero, so rare contexts decide little and shorter, more frequent ones stand in."""

    def __init__(self, texts: list[str], epochs: int = 4, pull: float = 1e-5) -> None:
        found: set[str] = set()
        for t in texts:
            for m in _SENTENCE.finditer(CITATION.sub("", INVISIBLE.sub("", t))):
                s = _STOP.sub("", m.group().strip())
                if len(s) > 3 and _STOP.search(m.group().strip()):
                    found.add(s)
        sentences = sorted(found)
        counts = Counter(w for s in sentences for w in set(_CLAUSE.sub(" ", s).lower().split()))
        self.words = {w for w, n in counts.items() if n > 1}
        rng = np.random.default_rng(11)
        rows, labels = [], []
        for s in sentences:
            rows.append(contexts_of(s, self.words))
            labels.append(1.0)
            borders = [m.start() for m in _CLAUSE.finditer(s) if m.start() > 1]
            cuts = {int(c) for c in rng.integers(2, len(s), 2)} | {int(rng.integers(max(2, len(s) - 6), len(s)))}
            cuts |= {int(c) for c in rng.choice(borders, min(2, len(borders)), replace=False)} if borders else set()
            for c in sorted(cuts):
                rows.append(contexts_of(s[:c], self.words))
                labels.append(0.0)
        self.weights = np.zeros(CONTEXTS, dtype=np.float32)
        if not rows:
            return
        places = np.full((len(rows), max(map(len, rows))), CONTEXTS, dtype=np.int64)  # the last cell is for no context
        for i, r in enumerate(rows):
            places[i, : len(r)] = r
        y = np.array(labels)
        balance = np.where(y > 0, (len(y) - y.sum()) / max(1.0, y.sum()), 1.0)
        w, square = np.zeros(CONTEXTS + 1), np.full(CONTEXTS + 1, 1e-2)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 2048)):
                f = places[part]
                p = 1 / (1 + np.exp(-np.clip(w[f].sum(axis=1), -30, 30)))
                g = np.broadcast_to(((p - y[part]) * balance[part])[:, None], f.shape)
                grad = np.bincount(f.ravel(), weights=g.ravel(), minlength=CONTEXTS + 1)
                used = np.flatnonzero(grad[:-1])
                step = grad[used] + pull * len(part) * w[used]
                square[used] += step**2
                w[used] -= 0.2 * step / np.sqrt(square[used])
        self.weights = w[:-1].astype(np.float32)

    def odds(self, content: str) -> float:
        """Log odds that ``content``, which has no stop at its end, may end there."""
        return float(self.weights[contexts_of(_last_sentence(content), self.words)].sum())

    def stops_early(self, content: str) -> bool:
        end = content[-64:]  # all of the end that these patterns look at
        if _HANGING.search(end) or unfinished_list(content):
            return True
        if _ELLIPSIS.search(end):
            return self.odds(_ELLIPSIS.sub("", content)) < LEAST_ODDS
        if _TERMINAL.search(end):
            return False
        depth = 0
        for c in content:
            depth = depth + 1 if c in _OPEN else max(0, depth - 1) if c in _CLOSE else depth
        return depth > 0 or self.odds(content) < LEAST_ODDS


def unfinished_list(content: str) -> bool:
    """Whether a text announces a number of points and numbers fewer, or ends in the mark of a next point."""
    if _NEXT_POINT.search(content[-64:]):
        return True
    m = _ANNOUNCED.search(content)
    if not m:
        return False
    said = next(g for g in m.groups() if g).lower()
    want = int(said) if said.isdecimal() else NUMERALS[said]
    seen = {_ORDINALS[x.lower()] for x in _ORDINAL.findall(content)}
    return 0 < len(seen) and max(seen) < want


def defect_of(question: str | None, answer: str | None, answerable: bool | None, abstained: bool | None, model: TerminalContexts, meter: CopyMeter) -> tuple[str | None, float]:
    """The defect of a pair or None, and its copy ratio.

    No content is a defect unless the pair abstains where no answer is possible; refusals are defects
    where an answer is possible (null counts as possible)."""
    content = content_of(answer)
    may_abstain = answerable is not None and not answerable
    if is_empty(content):
        return (None if may_abstain and abstained else "empty"), 1.0
    if is_refusal(content):
        return (None if may_abstain else "refusal"), 1.0
    question = question or ""
    sq, sa = squeeze(question), squeeze(LABEL.sub("", content))
    ratio = meter.ratio(sq, sa)
    if ratio <= COPY_RATIO and is_echo(sq, sa):
        return "echo", ratio
    theirs, ours = language_of(content), language_of(question)
    if theirs and ours and theirs != ours and theirs != asked_language(question):
        return "language", ratio
    if model.stops_early(content):
        return "truncated", ratio
    return None, ratio


def fit_terminal_contexts(df: DataFrame, answer: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> TerminalContexts:
    """Fit on at most ``rows`` answers, the first by hash, with at most ``chars`` characters of each."""
    a = F.col(answer)
    sample = (
        df.where(F.length(a) > 20)
        .select(F.substring(a, 1, chars).alias("t"), F.xxhash64(a).alias("h"))
        .orderBy("h", "t")
        .limit(rows)
    )
    return TerminalContexts([r["t"] for r in sample.collect()])


def flag_broken_pairs(
    df: DataFrame,
    key: str = "case_id",
    question: str = "question",
    answer: str = "answer",
    answerable: str | None = "answerable",
    abstained: str | None = "abstained",
) -> DataFrame:
    """One row per distinct pair: key, question, answer, ``copy_ratio`` and ``defect`` (null: none).

    Exact repeats of a pair give one row. A null question makes no echo and no language defect; null or
    blank answers are ``empty``; missing flags count as answerable and not abstained. Texts are read
    whole, whatever their length. Other columns of ``df`` are ignored; an empty table gives an empty one.
    """
    flag = lambda c: F.col(c).cast("boolean") if c else F.lit(None).cast("boolean")
    pairs = df.select(
        F.col(key).cast("string").alias("key"), F.col(question).cast("string").alias("question"), F.col(answer).cast("string").alias("answer"),
        flag(answerable).alias("answerable"), flag(abstained).alias("abstained"),
    )
    model = df.sparkSession.sparkContext.broadcast(fit_terminal_contexts(pairs, "answer"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contexts, meter = model.value, CopyMeter()
        none = lambda v: None if v is None or v != v else bool(v)
        for b in batches:
            found = [
                defect_of(q, a, none(x), none(y), contexts, meter)
                for q, a, x, y in zip(b["question"], b["answer"], b["answerable"], b["abstained"])
            ]
            yield pd.DataFrame({"key": b["key"], "question": b["question"], "answer": b["answer"], "copy_ratio": [r for _, r in found], "defect": [d for d, _ in found]})

    out = pairs.mapInPandas(label, "key string, question string, answer string, copy_ratio double, defect string")
    return out.dropDuplicates().withColumnRenamed("key", key)


def defects(df: DataFrame, key: str = "case_id", **columns: str | None) -> DataFrame:
    """Distinct (key, defect) of the broken pairs."""
    return flag_broken_pairs(df, key, **columns).where(F.col("defect").isNotNull()).select(key, "defect").distinct()


def defect_summary(df: DataFrame, by: Column) -> DataFrame:
    """Pairs and broken pairs by a column of the flagged table."""
    return df.groupBy(by.alias("group")).agg(F.count("*").alias("pairs"), F.count("defect").alias("broken"))
