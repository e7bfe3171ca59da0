"""Text expressions. White space is Unicode white space, as in Python, unless a name says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WS = r"(?U)\s+"
#: Ends of sentences, for the rhythm statistics and for the first sentence.
SENTENCE_END = "[。！？!?；;\\n]"
FIRST_END = "[。！？；!?]"
FOOTNOTE_LINE = r"(?m)^\[\^[^\]]+\]:.*$"
FOOTNOTE_MARK = r"\[\^([^\]]+)\]"
FOOTNOTE_DEF = r"(?m)^\[\^(\d+)\]:[ \t]*\[条目[ \t]*(\d+)\][ \t]*(.*)$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
CJK = r"[一-鿿]"
KANA = r"[぀-ヿ]"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """The compatibility form; Spark has no such function."""
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def variant_kind(value: Column) -> Column:
    """Type of a JSON value: string, boolean, void (JSON null), a number's type, or null if there is none."""
    return F.lower(F.regexp_extract(F.schema_of_variant(value), "^[A-Za-z]+", 0))


def or_default(value: Column, default) -> Column:
    """``value or default``: zero and the empty string count as missing too."""
    lit = F.lit(default)
    missing = F.lit("") if isinstance(default, str) else F.lit(0)
    return F.coalesce(F.nullif(value, missing), lit)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def squeeze(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, WS, "")


def norm(text: Column) -> Column:
    """Without white space, in lower case; null becomes empty."""
    return F.lower(squeeze(F.coalesce(text, F.lit(""))))


def strip_footnotes(text: Column) -> Column:
    """Without footnote definitions and footnote marks."""
    return F.when(F.contains(text, F.lit("[^")), F.regexp_replace(F.regexp_replace(text, FOOTNOTE_LINE, ""), FOOTNOTE_MARK, "")).otherwise(text)


def clean_text(text: Column) -> Column:
    return squeeze(strip_footnotes(text))


def nfkc_norm(text: Column) -> Column:
    """``norm`` of the compatibility form (NFKC): full-width and half-width spellings become equal."""
    return norm(nfkc(text))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def first_sentence(text: Column, max_chars: int = 120) -> Column:
    """The first sentence with its end mark, at most ``max_chars`` and then an ellipsis; empty for blank text."""
    folded = fold(F.coalesce(text, F.lit("")))
    head = F.trim(F.regexp_extract(folded, f"^([^。！？；!?]*(?:{FIRST_END})?)", 1))
    cut = F.when(head == "", folded).otherwise(head)
    return F.when(F.length(cut) > max_chars, F.concat(F.rtrim(F.substring(cut, 1, max_chars)), F.lit("…"))).otherwise(cut)


def detect_lang(text: Column) -> Column:
    """ja if there is kana, zh if over a tenth of the characters is CJK, else en; empty for blank text."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit(CJK))
    return F.when(strip(t) == "", "").when(t.rlike(KANA), "ja").when(cjk * 10 > F.length(t), "zh").otherwise("en")


def title_key(title: Column) -> Column:
    """Title without white space and punctuation, in lower case, for groups of equal titles."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)[\s\W_]+", ""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def ngrams(text: Column, n: int) -> Column:
    """All substrings of n characters in order, in linear time; none if the text is shorter."""
    spans = lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.array_join(F.slice(chars, i, n), ""))
    return F.when(F.length(text) >= n, bound(F.split(text, "", -1), spans)).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, n: int, size: int = 512) -> Column:
    """Overlapping parts whose n-grams together are those of the text: ``size`` of them in each part at most."""
    part = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - n) / size).cast("int")), lambda i: F.substr(t, i * size + 1, F.lit(size + n - 1)))
    return bound(text, lambda t: F.when(F.length(t) >= n, part(t)).otherwise(F.array().cast("array<string>")))


def bigrams(text: Column) -> Column:
    return F.array_distinct(ngrams(text, 2))


def bigram_dice(a: Column, b: Column, grams_a: Column | None = None, grams_b: Column | None = None) -> Column:
    """Dice coefficient of the sets of character bigrams; texts under two characters must be equal.

    Sets computed once per row (``bigrams``) can be passed.
    """
    ga, gb = grams_a if grams_a is not None else bigrams(a), grams_b if grams_b is not None else bigrams(b)
    ratio = lambda p: F.lit(2.0) * F.size(F.array_intersect(p["ga"], p["gb"])) / (F.size(p["ga"]) + F.size(p["gb"]))
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when(short, (a == b).cast("double")).otherwise(bound(F.struct(ga.alias("ga"), gb.alias("gb")), ratio))


def sentence_lengths(text: Column) -> Column:
    """Lengths without white space of the sentences that have over one character after stripping."""
    parts = F.split(strip_footnotes(text), SENTENCE_END, -1)
    return F.transform(F.filter(parts, lambda s: F.length(strip(s)) > 1), lambda s: F.length(squeeze(s)))


def population_stddev(values: Column) -> Column:
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    spread = lambda v, mean: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return bound(values, lambda v: bound(total(v) / F.size(v), lambda mean: F.sqrt(spread(v, mean) / F.size(v))))


def rhythm_stddev(text: Column, min_sentences: int = 5) -> Column:
    """Population deviation of the sentence lengths, unrounded; null under ``min_sentences``."""
    return bound(sentence_lengths(text), lambda v: F.when(F.size(v) >= min_sentences, population_stddev(v)))


def footnote_marks(text: Column) -> Column:
    """Distinct numbers of footnote marks outside of the definition lines."""
    body = F.regexp_replace(text, FOOTNOTE_LINE, "")
    marks = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"\[\^(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))
    return F.when(~F.contains(text, F.lit("[^")), F.array().cast("array<int>")).otherwise(marks)


def footnote_defs(text: Column) -> Column:
    """Array of struct(k, item_id, quote); of definitions with the same number the last one counts."""
    part = lambda g: F.regexp_extract_all(text, F.lit(FOOTNOTE_DEF), F.lit(g))
    rows = F.transform(
        F.arrays_zip(part(1).alias("k"), part(2).alias("item_id"), part(3).alias("quote")),
        lambda r: F.struct(r["k"].cast("int").alias("k"), r["item_id"].cast("long").alias("item_id"), strip(r["quote"]).alias("quote")),
    )
    last = bound(rows, lambda found: F.filter(found, lambda r, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["k"] == r["k"])))
    return F.when(~F.contains(text, F.lit("[^")), F.array().cast("array<struct<k:int,item_id:bigint,quote:string>>")).otherwise(last)


def break_delimiters(text: Column, tags: tuple[str, ...] = ("document",)) -> Column:
    """Puts a zero-width space into the tags that frame untrusted text: before the end of a closing one, behind the
    name of an opening one. Only the exact spelling of the frame is touched."""
    for tag in tags:
        text = F.replace(F.replace(text, F.lit(f"</{tag}>"), F.lit(f"</{tag}​>")), F.lit(f"<{tag}"), F.lit(f"<{tag}​"))
    return text


def json_block(text: Column) -> Column:
    """From the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def html_title(html: Column) -> Column:
    """The first title element with folded white space; empty without one."""
    return fold(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html: Column, max_chars: int = 100_000) -> Column:
    """Tags become blanks, white space is folded, and the text is cut at ``max_chars``."""
    return F.substring(fold(F.regexp_replace(html, r"<[^>]+>", " ")), 1, max_chars)


def article_title(text: Column, longest: int = 40) -> Column:
    """The first line that is not blank but for heading marks, without footnote marks.

    A longer one is a sentence: it is cut before the first pause within ``longest`` characters, or at that length.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END, -1), lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    first = strip(F.regexp_replace(F.get(F.filter(lines, lambda x: x != ""), 0), FOOTNOTE_MARK, ""))
    head = F.substring(first, 1, longest)
    cut = F.regexp_extract(head, "^([^。：；！？，]*)[。：；！？，]", 1)
    return F.coalesce(F.when(F.length(first) <= longest, first).when(head.rlike("[。：；！？，]"), cut).otherwise(head), F.lit("（无题）"))


def escape_tags(body: Column) -> Column:
    """Angle brackets that could start a tag become entities; lone ones stay."""
    return F.regexp_replace(body, r"<(?=[a-zA-Z/!])", "&lt;")


def scrub(text: Column, secrets: list[str]) -> Column:
    """Replaces every secret by three stars."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("***"))
    return text
