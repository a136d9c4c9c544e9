"""Problem 8: mixing sources to target shares of tokens, by iterative proportional fitting.

Documents are measured once: tokens of a public tokenizer, language, topic. Their token weights by source,
language and topic are raked to the target shares of the sources and to the languages' and topics' own
shares of the corpus, never beyond the repeats a source is allowed. Then documents are sampled by the
calibrated probabilities: the whole part of a weight as sure copies, the rest by sequential Poisson
sampling, whose last threshold is set so that each source meets its tokens to within one document.

Only the cells of the table source x language x topic and histograms of fixed size come to the driver.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.pairs import language_of
from marlstone.session import cut_table

TOKENIZERS = os.environ.get("MARLSTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts longer than this are tokenized in pieces cut at blanks or line ends, which bounds memory.
PIECE = 200_000
MAX_ROUNDS, CLOSE = 200, 1e-9
#: Buckets of each of the two histograms that the last threshold is read from.
BINS = 4096

# Topics by words in either language; the topic with the most hits, ties to the first.
TOPICS = {
    "retrieval": "检索 召回 重排 向量 索引 切片 retrieval recall rerank vector index chunking",
    "annotation": "标注 标签 样本 抽查 annotation label sample inspection",
    "interview": "面试 答辩 演示 问答 interview defence demo tutoring",
    "experiment": "实验 训练 评测 部署 experiment training evaluation deployment",
    "writing": "论文 文档 笔记 复述 审稿 paper section page rehearse review",
}
_TOPIC = re.compile("|".join(f"(?P<{k}>{'|'.join(v.split())})" for k, v in TOPICS.items()), re.I)


class TokenCounter:
    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_public_tokenizers", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        if len(text) <= PIECE:
            return len(self.encoding.encode_ordinary(text))
        total, at = 0, 0
        while at < len(text):
            end = min(len(text), at + PIECE)
            if end < len(text):
                end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end), at + PIECE // 2)
            total += len(self.encoding.encode_ordinary(text[at:end]))
            at = end
        return total


def source_name(col: Column) -> Column:
    """Trimmed, in lower case, blanks and hyphens as underscores; null if nothing is left."""
    c = F.regexp_replace(F.lower(F.regexp_replace(col, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")), r"[\s\p{Z}-]+", "_")
    return F.when(c != "", c)


def topic_of(text: str) -> str:
    hits: dict[str, int] = {}
    for m in _TOPIC.finditer(text):
        hits[m.lastgroup] = hits.get(m.lastgroup, 0) + 1
    return max(TOPICS, key=lambda k: hits.get(k, 0)) if hits else "other"


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", tokenizers: str = TOKENIZERS) -> DataFrame:
    """doc, source (cleaned, null if unknown), lang (of the text where null), topic, tokens. Null texts have
    no tokens."""
    rows = df.select(F.col(key).alias("d"), F.col(text).cast("string").alias("t"), source_name(F.col(source)).alias("source"), F.regexp_extract(F.lower(F.trim(F.col(lang))), r"^([a-z]{2,3})\b", 1).alias("lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(tokenizers)
        for b in batches:
            texts = [t or "" for t in b["t"]]
            langs = [x if isinstance(x, str) and x else (language_of(t) or "und") for x, t in zip(b["lang"], texts)]
            yield pd.DataFrame({"d": b["d"].to_numpy(), "source": b["source"].to_numpy(), "lang": langs, "topic": [topic_of(t) for t in texts], "tokens": [counter.count(t) for t in texts]})

    return rows.mapInPandas(run, f"d {dict(rows.dtypes)['d']}, source string, lang string, topic string, tokens long")


def _fill(weights: np.ndarray, caps: np.ndarray, target: float) -> np.ndarray:
    """Weights times one factor, each at most its cap, that sum to the target (or to all caps)."""
    if target >= caps.sum():
        return caps.copy()
    w = np.where((weights <= 0) & (caps > 0), 1e-12, weights)
    low, high = 0.0, 1.0
    while np.minimum(caps, w * high).sum() < target:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if np.minimum(caps, w * mid).sum() < target:
            low = mid
        else:
            high = mid
    return np.minimum(caps, w * high)


def rake(tokens: np.ndarray, caps: np.ndarray, groups: list[np.ndarray], targets: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Iterative proportional fitting of cell weights, starting from ``tokens``, to the marginals; the first
    one is met exactly, the others as far as caps and the first allow."""
    w, rounds = tokens.astype(float).copy(), 0
    for rounds in range(1, MAX_ROUNDS + 1):
        before = w.copy()
        for g, t in [*zip(groups[1:], targets[1:]), (groups[0], targets[0])]:
            for i, want in enumerate(t):
                mine = g == i
                w[mine] = _fill(w[mine], caps[mine], want)
        if np.abs(w - before).max(initial=0) <= CLOSE * max(1.0, w.sum()):
            break
    return w, rounds


@dataclass
class Mix:
    """``selection``: document, source, lang, topic, tokens, copies (1 or more). ``shares``: a row per target
    source. ``cells``: the raked weights."""

    selection: DataFrame
    shares: DataFrame
    cells: DataFrame
    total: float
    rounds: int


def mix(
    df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    total_tokens: float | None = None, tokenizers: str = TOKENIZERS, seed: int = 11,
) -> Mix:
    """Select documents so that each source has its ``target_share`` of all tokens.

    ``targets``: source, target_share, max_repeats; one row a source, names cleaned like those of the
    documents. The size is ``total_tokens``, or as much as all shares and repeats allow; a source without
    tokens is left out and the other shares are scaled up to 1. Documents of other or null sources are not
    selected. Repeated rows are documents of their own. No documents or no targets give an empty selection.
    Ties cannot occur: the order is by hash of seed and document, then the document."""
    spark = df.sparkSession
    docs = cut_table(measure(df, key, text, source, lang, tokenizers))
    named = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"))
    wanted = {r["source"]: (r["share"], r["most"]) for r in named.where("source is not null and share > 0 and most > 0").collect()}  # a row a source
    known = docs.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0)) if wanted else docs.where("false")
    cells = known.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens")).orderBy("source", "lang", "topic").toPandas()
    have = cells.groupby("source")["tokens"].sum().to_dict()
    names = sorted(have)
    whole = sum(wanted[s][0] for s in names)
    most_total = min((have[s] * wanted[s][1] * whole / wanted[s][0] for s in names), default=0.0)
    total = min(most_total, total_tokens) if total_tokens else most_total
    rounds = 0
    if names:
        langs, topics = sorted(cells["lang"].unique()), sorted(cells["topic"].unique())
        place = lambda col, values: cells[col].map({v: i for i, v in enumerate(values)}).to_numpy()
        own = lambda col, values: np.array([cells.loc[cells[col] == v, "tokens"].sum() for v in values]) / cells["tokens"].sum() * total
        caps = cells["tokens"].to_numpy(float) * cells["source"].map(lambda s: wanted[s][1]).to_numpy(float)
        w, rounds = rake(
            cells["tokens"].to_numpy(float), caps,
            [place("source", names), place("lang", langs), place("topic", topics)],
            [np.array([wanted[s][0] / whole * total for s in names]), own("lang", langs), own("topic", topics)],
        )
        cells["weight"] = w
        cells["ratio"] = np.minimum(w / cells["tokens"], caps / cells["tokens"])
    else:
        cells["weight"] = cells["ratio"] = pd.Series(dtype=float)
    cell_schema = "source string, lang string, topic string, tokens long, weight double, ratio double"
    cell_table = spark.createDataFrame([tuple(r) for r in cells.itertuples(index=False)], cell_schema)

    # The whole part of the ratio is sure; ``xi`` orders documents for the rest.
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("d")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sure = F.floor(F.col("ratio") + 1e-9).cast("int")
    part = F.greatest(F.col("ratio") - sure, F.lit(0.0))
    placed = known.join(F.broadcast(cell_table.drop("tokens", "weight")), ["source", "lang", "topic"])
    placed = placed.withColumn("sure", sure).withColumn("xi", F.when(part > 1e-9, u / part))
    bin1 = F.least(F.lit(BINS - 1), F.floor(F.log2(1 + F.col("xi")) * (BINS / 16)).cast("int"))
    bin2 = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("d")), F.lit(BINS)).cast("int")
    placed = placed.withColumn("b1", bin1).withColumn("b2", bin2)
    aim = {s: wanted[s][0] / whole * total for s in names}
    first = placed.groupBy("source", "b1").agg(F.sum(F.col("tokens") * F.col("sure")).alias("base"), F.sum("tokens").alias("tokens")).toPandas()  # sources x BINS
    edge: dict[str, tuple[int, float]] = {}
    for s in names:
        mine = first[first["source"] == s]
        left = aim[s] - mine["base"].sum()
        edge[s] = (BINS, 0.0)
        for b, t in mine[mine["b1"].notna()].sort_values("b1")[["b1", "tokens"]].itertuples(index=False):
            if t > left:
                edge[s] = (int(b), float(left))
                break
            left -= t
    edges = spark.createDataFrame([(s, b) for s, (b, _) in edge.items()], "source string, edge int")
    at_edge = placed.join(F.broadcast(edges), "source")
    second = at_edge.where("b1 = edge").groupBy("source", "b2").agg(F.sum("tokens").alias("tokens")).toPandas()  # sources x BINS
    last = []
    for s in names:
        left, cut = edge[s][1], 0
        for b, t in second[second["source"] == s].sort_values("b2")[["b2", "tokens"]].itertuples(index=False):
            if t > left:
                break
            left, cut = left - t, int(b) + 1
        last.append((s, edge[s][0], cut))
    ends = spark.createDataFrame(last, "source string, edge int, cut int")
    more = F.coalesce(F.when((F.col("b1") < F.col("edge")) | ((F.col("b1") == F.col("edge")) & (F.col("b2") < F.col("cut"))), 1), F.lit(0))
    chosen = placed.join(F.broadcast(ends), "source").withColumn("copies", F.col("sure") + more).where("copies > 0")
    selection = chosen.select(F.col("d").alias(key), "source", "lang", "topic", "tokens", "copies")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_selected"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    all_tokens = F.broadcast(got.agg(F.sum("tokens_selected").alias("all_tokens")))
    shares = (
        named.join(F.broadcast(got), "source", "left").crossJoin(all_tokens)  # one row
        .select(
            "source", F.col("share").alias("target_share"), F.coalesce(F.try_divide(F.col("tokens_selected"), F.col("all_tokens")), F.lit(0.0)).alias("actual_share"),
            F.coalesce("tokens_selected", F.lit(0)).alias("tokens_selected"), F.coalesce("documents", F.lit(0)).alias("documents"),
            F.col("most").alias("max_repeats"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )
    return Mix(selection, shares, cell_table, float(total), rounds)
