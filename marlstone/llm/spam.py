"""Problem 9: pages of repeated keywords, bare links or product tags instead of sentences.

Words are Han characters, words of other letters, and one word each for a link, a hash tag and a number.
Counts of words and of neighbouring pairs over the corpus, each text once up to form, held in count sketches
of fixed size, give each page

- ``pmi``: the mean pointwise mutual information of its neighbouring words;
- ``coherence``: by how much it exceeds that of the same words shuffled, over pairs of words that the rest of the
  corpus knows. About 0 for word salad, whatever its words and the size of the corpus;
- ``repeated``: the share of its pairs that occur three times or more in it, and ``burst``: how far these
  collocations exceed their share of the corpus (their part of the divergence of page from corpus);
- ``kinds``: different pairs by pairs, which is low where little but the same collocations comes, however
  common such pages are in the corpus;
- ``links``: the share of links and tags among its words.

A page is spam if repeated collocations dominate it, if links and tags are dense, or if its neighbours
are independent of each other. The page's own counts are taken off the corpus counts. The sketches get four
cells for each word of the corpus, up to 2^MOST_CELLS; with more distinct pairs than cells ``burst`` gets too small.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import mix64, squeezed_column

#: Thresholds: of burst times repeated share, of links and tags among words; least words of a page.
LEAST_REPETITION, LEAST_LINKS, LEAST_WORDS = 1.7, 0.125, 12
#: Word salad: coherence below the first, in at least so many pairs of known words that are that share of all. A
#: word is known if the rest of the corpus has it so often. Shuffled pages stay below 0.6 here, all others are above 2.6.
LEAST_COHERENCE, KNOWN_PAIRS, KNOWN_SHARE, KNOWN = 1.0, 30, 0.5, 20
#: Repeated share and kinds from which repetition is excessive whatever the corpus holds.
MOST_REPEATED, FEW_KINDS = 0.75, 0.3
REPEATS = 3
#: Cells of a sketch row, and rows: the least of the rows is the estimate.
LEAST_CELLS, MOST_CELLS, DEPTH = 17, 21, 2
CHUNK = 1 << 13
#: Texts that are worked on at once.
BLOCK = 200

LINK = re.compile(r"<a\s[^>]*>|</a>|(?:https?://|ftp://|www\.)[^\s)>\]\"'<，。；]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s)>\]\"'<，。；]*", re.I)
TAG = re.compile(r"[#＃](?=[^\s#＃])[^\s#＃]*[#＃]?")
NUMBER = re.compile(r"[￥¥$€£]\s*\d[\d.,]*|\b[a-z]{2,4}\d{4,}\b|[0-9０-９][\d.,]*", re.I)
WORD = re.compile(r"[\x01\x02\x03]|[㐀-鿿豈-﫿぀-ヿ가-힯]|[^\W\d_㐀-鿿豈-﫿぀-ヿ가-힯]+(?:['’-][^\W\d_㐀-鿿]+)*")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    if "/" in low or "www." in low or "<a" in low:  # each kind of link has one of these
        text = LINK.sub(" \x01 ", text)
    if "#" in text or "＃" in text:
        text = TAG.sub(" \x02 ", text)
    return WORD.findall(NUMBER.sub(" \x03 ", text).lower())


class _Hashes:
    """Word to 64-bit hash, the same in every process."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, tokens: list[str]) -> list[int]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = []
        for w in tokens:
            h = known.get(w)
            if h is None:
                b = w.encode("utf-8", "surrogatepass")
                h = known[w] = (zlib.crc32(b) << 32) | zlib.adler32(b[::-1])
            out.append(h)
        return out


_LINKS = np.array(_Hashes().of(["\x01", "\x02"]), dtype=np.uint64)


def _flat(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, text of each, hashes of neighbouring pairs, text of each."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    codes, kinds = pd.factorize(np.array([x for y in lists for x in y], dtype=object))
    w = np.array(hashes.of(list(kinds)), dtype=np.uint64)[codes] if len(codes) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(lists)), sizes)
    same = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, dtype=bool)
    with np.errstate(over="ignore"):
        pairs = mix64(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])[same] if len(w) > 1 else w[:0]
    return w, owner, pairs, owner[:-1][same] if len(owner) > 1 else owner[:0]


def _blocks(texts: pd.Series) -> Iterator[list[str | None]]:
    """The texts of a batch, few at a time: what is computed for a block is many times as large as its texts."""
    for i in range(0, len(texts), BLOCK):
        yield list(texts.iloc[i : i + BLOCK])


def _cell(h: np.ndarray, row: int, cells: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h + np.uint64(row * 0x51ED27)) & np.uint64(cells - 1)).astype(np.int64)


def estimate(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.minimum.reduce([sketch[r][_cell(h, r, sketch.shape[1])] for r in range(DEPTH)])


def distinct_texts(texts: DataFrame) -> DataFrame:
    """One text ``t`` of each set of copies up to form, so that copies are not the corpus they are compared with."""
    return texts.where("t is not null").groupBy(F.xxhash64(squeezed_column(F.col("t"))).alias("h")).agg(F.min("t").alias("t")).select("t")


def cells_for(words: float) -> int:
    """Cells of a row of a sketch for so many words of the corpus."""
    return 1 << min(MOST_CELLS, max(LEAST_CELLS, int(4 * words).bit_length()))


def corpus_counts(texts: DataFrame, most_words: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sketches of the word and of the pair counts over the column ``t`` of at most so many words, and the totals."""
    cells = cells_for(most_words)
    sizes = {"w": cells, "p": cells}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {k: np.zeros((DEPTH, n), dtype=np.uint32) for k, n in sizes.items()}
        hashes = _Hashes()
        for b in batches:
            for texts in _blocks(b["t"]):
                w, _, p, _ = _flat(texts, hashes)
                for k, h in (("w", w), ("p", p)):
                    for r in range(DEPTH):
                        np.add.at(sums[k][r], _cell(h, r, sizes[k]), np.uint32(1))
        for k, n in sums.items():
            parts = n.reshape(-1, CHUNK)
            yield pd.DataFrame({"k": k, "chunk": range(len(parts)), "counts": [x.astype(np.float32).tobytes() for x in parts]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK)
        for x in part["counts"]:
            total += np.frombuffer(x, dtype=np.float32)
        return pd.DataFrame({"k": [part["k"].iloc[0]], "chunk": [part["chunk"].iloc[0]], "counts": [total.tobytes()]})

    schema = "k string, chunk int, counts binary"
    out = {k: np.zeros(DEPTH * n) for k, n in sizes.items()}
    for r in texts.mapInPandas(count, schema).groupBy("k", "chunk").applyInPandas(add, schema).collect():  # of fixed size
        out[r["k"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], dtype=np.float64)
    w, p = (out[k].reshape(DEPTH, n) for k, n in sizes.items())
    return w.astype(np.float32), p.astype(np.float32), float(w[0].sum()), float(p[0].sum())


def page_features(texts: list[str | None], hashes: _Hashes, word_counts: np.ndarray, pair_counts: np.ndarray, n_words: float, n_pairs: float) -> pd.DataFrame:
    w, owner, p, pair_owner = _flat(texts, hashes)
    n = len(texts)
    size = np.bincount(owner, minlength=n)
    links = np.bincount(owner[np.isin(w, _LINKS)], minlength=n) / np.maximum(size, 1)
    order = np.lexsort((p, pair_owner))
    ps, po = p[order], pair_owner[order]
    new = np.ones(len(ps), dtype=bool)
    new[1:] = (ps[1:] != ps[:-1]) | (po[1:] != po[:-1])
    at = np.flatnonzero(new)
    c = np.diff(np.append(at, len(ps))).astype(np.float64)
    kind, who = ps[at], po[at]
    pairs = np.maximum(np.bincount(pair_owner, minlength=n), 1).astype(np.float64)
    others = np.maximum(estimate(pair_counts, kind) - c, 0) + 0.5
    share = c / pairs[who]
    often = c >= REPEATS
    repeated = np.bincount(who[often], weights=share[often], minlength=n)
    gain = share * np.log(share / (others / (n_pairs + 1)))
    burst = np.bincount(who[often], weights=gain[often], minlength=n)
    # PMI of neighbours and of the same words shuffled, with the page's own counts taken off.
    rest = np.maximum(estimate(word_counts, w) - _own_counts(w, owner), 0)
    log_share, known = np.log((rest + 1) / (n_words + 1)), rest >= KNOWN
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, dtype=np.int64)

    def pmi_of(order: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = np.log((np.maximum(estimate(pair_counts, hashes) - own, 0) + 0.5) / (n_pairs + 1))
        a, b = order[inner], order[inner + 1]
        return joint - log_share[a] - log_share[b], known[a] & known[b]

    c_of = np.empty(len(p))
    c_of[order] = np.repeat(c, c.astype(np.int64))
    pmi, both = pmi_of(np.arange(len(w)), p, c_of)
    with np.errstate(over="ignore"):
        at = np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
        mixed = np.lexsort((mix64(w + at.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), owner))
        q = mix64(w[mixed][:-1] * np.uint64(0x9E3779B97F4A7C15) + w[mixed][1:])[inner] if len(w) > 1 else w[:0]
        mine = mix64(kind + who.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        asked = mix64(q + pair_owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    by = np.argsort(mine)
    spot = np.minimum(np.searchsorted(mine[by], asked), max(0, len(by) - 1))
    own = np.where(mine[by][spot] == asked, c[by][spot], 0) if len(by) else np.zeros(len(q))
    mixed_pmi, mixed_both = pmi_of(mixed, q, own)
    mean = np.bincount(pair_owner, weights=pmi, minlength=n) / pairs

    def over_known(values: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.bincount(pair_owner[which], minlength=n)
        return np.bincount(pair_owner[which], weights=values[which], minlength=n) / np.maximum(m, 1), m

    (real, n_real), (chance, n_chance) = over_known(pmi, both), over_known(mixed_pmi, mixed_both)
    enough = (np.minimum(n_real, n_chance) >= KNOWN_PAIRS) & (np.minimum(n_real, n_chance) >= KNOWN_SHARE * pairs)
    kinds = np.bincount(who, minlength=n) / pairs
    coherence = np.where(enough, real - chance, np.nan)
    return pd.DataFrame({"words": size, "links": links, "repeated": repeated, "burst": burst, "kinds": kinds, "pmi": mean, "coherence": coherence})


def _own_counts(w: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each word occurs in its own text."""
    order = np.lexsort((w, owner))
    ws, wo = w[order], owner[order]
    fresh = np.ones(len(ws), dtype=bool)
    fresh[1:] = (ws[1:] != ws[:-1]) | (wo[1:] != wo[:-1])
    counts = np.diff(np.append(np.flatnonzero(fresh), len(ws)))
    own = np.empty(len(w))
    own[order] = np.repeat(counts, counts)
    return own


def score_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, ``words``, ``links``, ``repeated``, ``burst``, ``kinds``, ``pmi``, ``coherence`` (null
    where too few of its words are known) and ``spam`` with ``reason`` (links, repetition, salad, null). Null and empty texts have no words and are no spam, nor are
    pages of fewer than LEAST_WORDS words; texts are read whole; repeated rows stay; extra columns are
    ignored; an empty table gives an empty one."""
    rows = df.select(F.col(key).alias("d"), F.col(text).cast("string").alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0  # no text has more words than characters
    shared = df.sparkSession.sparkContext.broadcast(corpus_counts(distinct_texts(rows.select("t")), chars))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            parts = [page_features(texts, hashes, *shared.value) for texts in _blocks(b["t"])]
            if parts:
                f = pd.concat(parts, ignore_index=True)
                f.insert(0, "d", b["d"].to_numpy())
                yield f

    kind = dict(rows.dtypes)["d"]
    out = rows.mapInPandas(score, f"d {kind}, words long, links double, repeated double, burst double, kinds double, pmi double, coherence double")
    enough = F.col("words") >= LEAST_WORDS
    reason = (
        F.when(enough & (F.col("links") >= LEAST_LINKS), "links")
        .when(enough & ((F.col("burst") * F.col("repeated") >= LEAST_REPETITION) | ((F.col("repeated") >= MOST_REPEATED) & (F.col("kinds") <= FEW_KINDS))), "repetition")
        .when(enough & (F.col("coherence") < LEAST_COHERENCE), "salad")
    )
    out = out.withColumn("coherence", F.nanvl("coherence", F.lit(None).cast("double")))
    return out.withColumn("reason", reason).withColumn("spam", F.col("reason").isNotNull()).withColumnRenamed("d", key)


def spam_report(pages: DataFrame) -> DataFrame:
    """(reason, pages) of a table that ``score_pages`` made."""
    return pages.where("spam").groupBy("reason").agg(F.count("*").alias("pages"))


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return score_pages(df, key, text).where("spam").select(key).distinct()
