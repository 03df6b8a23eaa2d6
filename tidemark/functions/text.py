"""Text functions as column expressions; Python only where Spark has no built-in (NFKC, Python's number formats)."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

# Token pattern and stop words of lexical retrieval.
TOKEN = r"[a-z0-9]+(?:[-_.'][a-z0-9]+)*"
# Where sentences are cut; whitespace is what Java's regular expressions take for it.
SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]+(?=[A-Z(\"'\[])")
STOPWORDS = "a an the of and or to in on at for is are was were be been by with as that this it its from".split()


def tokens(text: Column, drop_stopwords: bool = True) -> Column:
    """Lower-cased retrieval tokens, duplicates kept."""
    out = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(out, lambda t: ~t.isin(STOPWORDS)) if drop_stopwords else out


def norm_value(value: Column) -> Column:
    """Trimmed, lower case, no commas, single spaces: how fact values are compared."""
    return F.trim(F.regexp_replace(F.replace(F.lower(F.trim(value)), F.lit(","), F.lit("")), r"\s+", " "))


def norm_answer(text: Column) -> Column:
    """Lower case, no articles, ASCII letters and digits only, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\b(a|an|the)\b", " "), "[^a-z0-9 ]", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def quality_ok(text: Column, min_chars: int = 200, max_symbols: float = 0.3, min_mean_word: float = 2.5, min_distinct: float = 0.25) -> Column:
    """Is a text long enough, mostly letters, of words of some length, and not one phrase over and over?"""
    size = F.length(text)
    good = F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(text, r"\s", ""))
    n = F.size(words)
    return F.coalesce((size >= min_chars) & (good / size >= 1 - max_symbols) & (n > 0) & (letters / n >= min_mean_word) & (F.size(F.array_distinct(words)) / n >= min_distinct), F.lit(False))


@F.pandas_udf(StringType())
def clean_text(text: pd.Series) -> pd.Series:
    """NFKC, no control characters, single blanks, at most one empty line, trimmed."""
    steps = ((re.compile(r"[\x00-\x08\x0e-\x1f\x7f]"), ""), (re.compile(r"[ \t\x0b\f\r]+"), " "), (re.compile(r"\n{3,}"), "\n\n"))

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t)
        for pattern, new in steps:
            t = pattern.sub(new, t)
        return t.strip()

    return text.map(one)


@F.arrow_udf(ArrayType(StructType().add("sentence", StringType()).add("start", IntegerType())))
def sentences(text: pa.Array) -> pa.Array:
    """Array of (sentence, start): cut behind . ! ? where a capital, a quote or a bracket follows.

    In Python, because an array that grows in `aggregate` is copied at each step: quadratic in a text's sentences.
    """
    cut, found, starts, ends = SENTENCE_END.finditer, [], [], [0]
    for t in text.to_pylist():
        at = 0
        for begin, end in (*(m.span() for m in cut(t)), (len(t), len(t))) if t is not None else ():
            part = t[at:begin].lstrip(" ")
            if part:
                found.append(part.rstrip(" "))
                starts.append(begin - len(part))
            at = end
        ends.append(len(found))
    rows = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.int32())], ["sentence", "start"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=text.is_null())


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out, entities for the five basic signs back."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def contextualized(title: Column, heading: Column, text: Column) -> Column:
    """Title and heading path before a chunk's text."""
    prefix = F.concat_ws(" > ", F.nullif(title, F.lit("")), F.nullif(heading, F.lit("")))
    return F.when(prefix != "", F.concat(prefix, F.lit("\n"), text)).otherwise(text)


def table_row(header: Column, row: Column) -> Column:
    """"h: c" pairs of one table row, joined by a bar."""
    return F.array_join(F.zip_with(header, row, lambda h, c: F.concat(h, F.lit(": "), c)), " | ")


def label(attribute: Column) -> Column:
    """Readable name of an attribute."""
    short = F.upper(attribute)
    return F.when(attribute.isin("ceo", "cto", "cfo"), short).otherwise(F.replace(attribute, F.lit("_"), F.lit(" ")))


def stable_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


@F.pandas_udf(StringType())
def human_amount(value: pd.Series, unit: pd.Series) -> pd.Series:
    """Amounts in words, with Python's rounding of two decimals (Spark's own formats round half up)."""

    def one(v: float, u: str) -> str | None:
        if pd.isna(v):
            return None
        if (u or "").lower() != "usd":
            return f"{v:,.0f} {u or ''}"
        scale = next(((d, s) for d, s in ((1e9, "billion"), (1e6, "million"), (1e3, "thousand")) if abs(v) >= d), None)
        return f"{v / scale[0]:.2f} {scale[1]} USD" if scale else f"{v:,.0f} USD"

    return pd.Series([one(v, u) for v, u in zip(value, unit, strict=True)])


def short_number(value: Column) -> Column:
    """Six significant digits, as Python's %g."""
    shown = F.format_string("%.5e", value)
    power, bare = F.substring_index(shown, "e", -1), lambda x: F.regexp_replace(x, r"\.?0+$", "")
    plain = bare(shown.try_cast("decimal(38,10)").cast("string"))
    whole = F.concat(F.regexp_replace(F.substring_index(shown, "e", 1), r"\.?0+$", ""), F.lit("e"), power)
    return F.when(value.isNotNull(), F.when(power.try_cast("int").between(-4, 5), F.when(value == 0, "0").otherwise(plain)).otherwise(whole))


def wiki_value(attribute: Column, value: Column) -> Column:
    """A usable infobox value: markup out; empty where no name (or, for revenue, no figure) remains."""
    v = F.element_at(F.split(F.coalesce(value, F.lit("")), r"\{\{", 2), 1)
    v = F.regexp_replace(F.regexp_replace(v, r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2"), r"[\[\]{}|<>]", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")
    bad = ~v.rlike("[A-Za-z]{2}") | ((attribute == "revenue") & ~v.rlike(r"\d"))
    return F.when(bad, F.lit("")).otherwise(v)


def distinct_tokens(name: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= least))


def mentions(text: Column, entity: Column) -> Column:
    """Do all distinctive tokens of an entity stand in the text?"""
    return F.forall(distinct_tokens(entity), lambda t: F.contains(F.lower(text), t))


def contains_entity(subject: Column, entity: Column) -> Column:
    return F.size(F.array_except(distinct_tokens(entity, 1), distinct_tokens(subject, 1))) == 0


def same_subject(a: Column, b: Column) -> Column:
    return F.arrays_overlap(distinct_tokens(a), distinct_tokens(b))


def fingerprint_text(text: Column) -> Column:
    """Text without lines that change at every poll, lower case, single spaces."""
    # Fixed value: what marks a volatile line.
    volatile = r"(?im)^.*(last updated|generated on|page loaded|copyright \d{4}|session id|\d{1,2}:\d{2}:\d{2}|csrf|nonce=)[^\n]*$"
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, volatile, "")), r"\s+", " "))


def content_digest(text: Column) -> Column:
    return F.sha2(fingerprint_text(text), 256)


def simhash(text: Column, digest: str = "blake2b", width: int = 3) -> Column:
    """64-bit SimHash of a polled text's word n-grams, each voting as often as it occurs (fewer words: the words); 0 without words, null for null."""
    head = {"blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(), "md5": lambda b: hashlib.md5(b, usedforsecurity=False).digest()[:8]}[digest]

    def one(t: str | None) -> int | None:
        if t is None:
            return None
        words = re.findall("[a-z0-9]+", t)
        grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or words
        if not grams:
            return 0
        bits = np.unpackbits(np.frombuffer(b"".join(head(g.encode()) for g in grams), dtype=np.uint8).reshape(-1, 8), axis=1)
        votes = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(grams))
        return int(votes.view(">i8")[0])

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="Int64")

    return of(fingerprint_text(text))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def infobox_field(wikitext: Column, *names: str) -> Column:
    """Raw value of the first named infobox field that has one, up to the next field or the end of the box; empty without one."""
    fields = [F.regexp_extract(wikitext, rf"(?ims)^\s*\|\s*{n}\s*=\s*(.*?)(?=^\s*\|\s*[\w ]+?\s*=|^\s*\}}\}}|\z)", 1) for n in names]
    return F.coalesce(*[F.when(F.trim(f) != "", f) for f in fields], F.lit(""))
