"""Text features as column expressions. Lengths and positions count code points throughout.

Nulls give null (arrays: null as well); empty texts give empty arrays unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "一-鿿"
HAN_AND_EXTENSION_A = "㐀-䶿一-鿿"

# Patterns that decide results.
LATIN_TERM = r"[a-zA-Z0-9_+.-]{2,}"
NUMBER_PREFIX = r"^(?i)(?:(?:Q|Question|问题)\s*)?[0-9０-９一二三四五六七八九十]+[.、:：)）-]?\s*"
QUESTION_PUNCTUATION = r"[,，.。;；:：!！?？'\"“”‘’()（）\[\]【】]"
TEMPLATE_ID = r"(?i)(?:case|chunk|source|document|portfolio|public)[_-]?[a-z0-9_-]+"
TEMPLATE_NUMBER = r"(?:19|20)\d{2}|\d+(?:\.\d+)?"
TEMPLATE_STEP = "步骤[一二三四五六七八九十甲乙丙丁戊己庚辛壬癸0-9]*"
TEMPLATE_PLACEHOLDER = "(?:合成)?主题|唯一规则|不存在的|公开合成"
LEXICAL_TOKEN = r"(?<![A-Za-z0-9])(?:\d+(?:\.\d+)?%?|[A-Za-z0-9]+)(?![A-Za-z0-9])"


def strip(col: Column) -> Column:
    """Without any white space at both ends, line ends and full-width blanks included."""
    return F.regexp_replace(col, r"^[\s　 ]+|[\s　 ]+$", "")


def normalize_text(col: Column) -> Column:
    """Line ends as LF, runs of blanks and tabs as one blank, more than one blank line as one, stripped."""
    unix = F.regexp_replace(col, "\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, "[ \t]+", " "), "\n{3,}", "\n\n"))


def paragraphs(col: Column) -> Column:
    """Non-empty stripped paragraphs between blank lines."""
    return F.filter(F.transform(F.split(col, r"\n\s*\n"), strip), lambda p: F.length(p) > 0)


def clean_question(col: Column) -> Column:
    return strip(F.regexp_replace(strip(col), NUMBER_PREFIX, ""))


def question_key(col: Column) -> Column:
    """A question without numbering, white space and punctuation, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(strip(col), NUMBER_PREFIX, ""), r"[\s　 ]+", "")
    return F.lower(F.regexp_replace(bare, QUESTION_PUNCTUATION, ""))


def answer_key(col: Column) -> Column:
    """Lower-case Latin letters, digits and Han characters only."""
    return F.regexp_replace(F.lower(col), f"[^a-z0-9{HAN}]+", "")


def template_text(col: Column) -> Column:
    """A text without ids, numbers, step words, placeholders and anything but letters and Han characters."""
    t = F.lower(col)
    for pattern in (TEMPLATE_ID, TEMPLATE_NUMBER, TEMPLATE_STEP, TEMPLATE_PLACEHOLDER):
        t = F.regexp_replace(t, pattern, " ")
    return F.regexp_replace(t, f"[^a-z0-9{HAN}]+", "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it within a lambda."""
    return F.transform(F.array(value), use)[0]


def ngrams(col: Column, n: int) -> Column:
    """All runs of ``n`` characters in order; a shorter text has none."""
    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, runs).when(t.isNotNull(), F.array().cast("array<string>"))

    return bound(col, of)


def ngram_set(col: Column, n: int, whole_if_short: bool = False) -> Column:
    """Distinct n-grams; with ``whole_if_short`` a text of at most ``n`` characters is one gram, an empty one none."""
    grams = F.array_distinct(ngrams(col, n))
    if not whole_if_short:
        return grams
    return F.when(F.length(col) == 0, F.array().cast("array<string>")).when(F.length(col) <= n, F.array(col)).otherwise(grams)


def array_shingles(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens, joined by a unit separator; fewer tokens have none."""
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), "\x1f"))
        return F.when(F.size(w) >= n, F.array_distinct(runs)).when(w.isNotNull(), F.array().cast("array<string>"))

    return bound(tokens, of)


def _han_terms(run: Column) -> Column:
    whole = F.when((F.length(run) >= 2) & (F.length(run) <= 8), F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.concat(ngrams(run, 1), ngrams(run, 2), whole)


def search_terms(col: Column) -> Column:
    """Terms of lexical search, repeats kept: Latin terms of two characters or more, then for each Han run
    its characters, its bigrams and, at two to eight characters, the run itself."""
    low = F.lower(col)
    latin = F.regexp_extract_all(low, F.lit(LATIN_TERM), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{HAN}]+"), F.lit(0))
    return F.concat(latin, F.flatten(F.transform(runs, _han_terms)))


def lexical_tokens(col: Column) -> Column:
    """Distinct numbers (decimals and percentages included) and alphanumeric words of two characters or more."""
    found = F.regexp_extract_all(F.replace(F.lower(col), F.lit("％"), F.lit("%")), F.lit(LEXICAL_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: t.endswith("%") | t.rlike("^[0-9]") | (F.length(t) >= 2)))


def informative_tokens(col: Column) -> Column:
    """Lexical tokens and the bigrams of Han runs, distinct."""
    runs = F.regexp_extract_all(col, F.lit(f"[{HAN_AND_EXTENSION_A}]+"), F.lit(0))
    return F.array_union(lexical_tokens(col), F.flatten(F.transform(runs, lambda r: ngrams(r, 2))))


def stable_id(prefix: str, *parts: Column, length: int = 24, sep: str = "|") -> Column:
    """``prefix`` and the first hex digits of the SHA-256 of the joined parts; null parts count as empty."""
    joined = F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def coverage(tokens: Column, within: Column) -> Column:
    """Share of distinct ``tokens`` that are in ``within``; 0 without tokens."""
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.array_intersect(tokens, within)) / n).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(both_empty))
