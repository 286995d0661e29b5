"""Text functions: Column -> Column from Spark's built-ins; NFKC alone needs Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = "[\\u4e00-\\u9fff]"


#: White space beyond Java's, letters and digits, and decimal digits.
SPACE, SOLID, DIGIT = r"[\s\x1c-\x1f]", r"[\p{L}\p{N}]", r"\p{Nd}"
#: What cleaning replaces after NFKC, in this order.
CLEANING = (
    ("[\\u200b-\\u200f\\u202a-\\u202e\\ufeff\\u00ad]", ""),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    (r"\r\n?", "\n"),
    (r"([A-Za-z])-\n([a-z])", "$1$2"),
    (r"(?Umd)^[^\w\x{4e00}-\x{9fff}]\s*$", ""),
    ("[ \\t\\u3000]{2,}", " "),
    (r"\n{3,}", "\n\n"),
    (r"(?Umd)^[^\S\n]+|[^\S\n]+$", ""),
)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize(c: Column) -> Column:
    """Cleaned text; null becomes ''.

    NFKC, no invisible or control characters, LF line ends, words joined over
    hyphenated line ends, no lines of one lone symbol, single blanks, at most
    one blank line, no blanks at line ends.
    """
    t = _nfkc(F.coalesce(c, F.lit("")))
    for pattern, new in CLEANING:
        t = F.regexp_replace(t, pattern, new)
    return strip(t)


#: The same replacements for Python's own patterns.
_CLEANING = tuple(
    (re.compile(pattern), new)
    for pattern, new in (
        ("[\u200b-\u200f\u202a-\u202e\ufeff\u00ad]", ""),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
        (r"\r\n?", "\n"),
        (r"([A-Za-z])-\n([a-z])", r"\1\2"),
        (r"(?m)^[^\w\u4e00-\u9fff]\s*$", ""),
        ("[ \\t\u3000]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    )
)


def cleaned(text: str | None) -> str:
    """`normalize` of one text inside a Python task that has it at hand."""
    text = unicodedata.normalize("NFKC", text or "")
    for pattern, new in _CLEANING:
        text = pattern.sub(new, text)
    return "\n".join(line.strip() for line in text.split("\n")).strip()


def content_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(16))


def tokens(c: Column) -> Column:
    """Single characters and pairs of every CJK run, then lower-cased words of ASCII letters, digits and underscores; of one-letter words digits only."""
    pairs = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"({CJK}+)"), F.lit(1)), lambda s: F.concat(F.split(s, ""), F.when(F.length(s) >= 2, pairs(s)).otherwise(F.array().cast("array<string>"))))
    words = F.filter(F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))
    return F.concat(F.flatten(runs), F.transform(words, F.lower))


def cjk_ratio(c: Column) -> Column:
    """CJK characters by characters that aren't white space; 0 for none."""
    solid = F.regexp_replace(c, r"(?U)\s", "")
    return F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, f"[^{CJK[1:]}", "")) / F.length(solid)).otherwise(F.lit(0.0))


def is_noise(c: Column, least: int = 15, share: float = 0.3) -> Column:
    """Few characters, or too few letters and digits among them."""
    solid = F.regexp_replace(c, r"(?U)\s", "")
    useful = F.length(F.regexp_replace(solid, f"[^A-Za-z0-9{CJK[1:]}", ""))
    return (F.length(solid) < least) | (useful / F.length(solid) < share)


def truncate(c: Column, n: int, suffix: str = "…") -> Column:
    t = strip(c)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(n - len(suffix))), r"(?U)\s+$", ""), F.lit(suffix)))


def effective_length(c: Column) -> Column:
    """How many letters and digits there are."""
    return F.length(F.regexp_replace(c, f"[^{SOLID[1:]}", ""))


def sentences(c: Column) -> Column:
    """Parts between sentence marks (kept) and line breaks, stripped; parts of under 6 letters and digits join the next longer one, at the end the one before."""
    parts = F.filter(F.transform(F.split(c, r"(?<=[。！？；!?;])|\n+"), strip), lambda s: s != "")
    held = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda a, s: F.when(effective_length(s) < 6, F.struct(a["done"].alias("done"), F.concat(a["open"], s).alias("open"))).otherwise(F.struct(F.concat(a["done"], F.array(F.concat(a["open"], s))).alias("done"), F.lit("").alias("open"))),
    )
    done, rest = held["done"], held["open"]
    joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), rest)))
    return F.when(rest == "", done).when(F.size(done) == 0, F.array(rest)).otherwise(joined)


def phrases(c: Column, lengths: tuple[int, ...], most: int, distinct: bool) -> Column:
    """The first `most` substrings of the lengths in turn, all-blank ones left out."""
    of = lambda n: F.transform(F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(c, i, F.lit(n)))
    found = F.filter(F.concat(*(of(n) for n in lengths)), lambda s: strip(s) != "")
    return F.slice(F.array_distinct(found) if distinct else found, 1, most)


def numbers(c: Column) -> Column:
    """Distinct whole numbers with their decimals, as they stand in the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({DIGIT}+(?:\.{DIGIT}+)?)"), F.lit(1)))


def content_terms(tokens_: Column) -> Column:
    """Distinct tokens of two characters and more, or all if there are none."""
    long = F.array_distinct(F.filter(tokens_, lambda t: F.length(t) > 1))
    return F.when(F.size(long) > 0, long).otherwise(F.array_distinct(tokens_))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def safe_filename(c: Column) -> Column:
    """The last part of a path, `_` for all but letters, digits, `_`, `.` and `-`; `unnamed` if nothing is left."""
    name = F.regexp_extract(F.regexp_replace(c, r"(/+\.?)+$", ""), "([^/]*)$", 1)
    name = F.left(F.regexp_replace(F.when(name == ".", "").otherwise(name), r"[^\p{L}\p{N}_.\-]", "_"), F.lit(120))
    return F.when(name == "", F.lit("unnamed")).otherwise(name)


#: What a refusing answer says near its start.
REFUSALS = ("根据现有知识库无法回答", "根据现有资料无法回答", "无法根据现有资料")
#: The whole refusal, the line before an extracted answer, and what stands for no history and no context.
NO_ANSWER = "根据现有知识库无法回答该问题：没有检索到与该问题相关的文档片段。\n\n可能的原因：\n1. 知识库里还没有入库相关文档 —— 请先在左侧上传文件并点击「入库」；\n2. 问题用词与文档差异过大 —— 换一种更贴近原文的说法，或换个关键词再问；\n3. 文档已入库但切分/检索参数不合适 —— 可尝试调大「检索片段数」。"
EXTRACTED = "（离线抽取模式·未调用大模型）"
NO_HISTORY, NO_CONTEXT = "（无历史对话，这是本轮对话的第一个问题）", "（没有检索到任何相关资料）"


def is_refusal(c: Column) -> Column:
    head = F.left(strip(c), F.lit(80))
    found = F.lit(False)
    for marker in REFUSALS:
        found = found | F.contains(head, F.lit(marker))
    return c.isNull() | (strip(c) == "") | found


def headings(c: Column) -> Column:
    """Segments of a Markdown text, each from its heading on."""
    return F.split(c, "\\n(?=#{1,6}\\s)")
