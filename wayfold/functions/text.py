"""String columns: cleaning, tokens, chunks, prices, HTML and URL parts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(text: Column) -> Column:
    """Unescape the commonest entities, one blank for any run of white space, trim."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def chunks(text: Column, size: int, overlap: int) -> Column:
    """Structs (chunk, start, text) of windows of `size` characters, each `overlap` into the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1 - overlap, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda at, i: F.struct(i.alias("chunk"), at.alias("start"), F.substring(text, at + 1, F.lit(size)).alias("piece")))


def price(text: Column) -> Column:
    """The first decimal number of a text, as decimal(12,2); null where there is none."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("decimal(12,2)")


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1)


def residual(json: Column, known: list[str]) -> Column:
    """What a JSON record has besides the known attributes, as a map of text; values that aren't plain stay JSON. Null for
    what isn't a record."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: ~k.isin(known))


_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)\s*")


@F.udtf(returnType="chunk int, start int, piece string", useArrow=True)
class SentenceChunks:
    """(text, size) -> chunk, start, piece: whole sentences together, up to `size` characters; a longer sentence is cut. The
    pieces together are the text; a null or empty text has none. A text that goes to a language model in such pieces
    doesn't break off within a sentence, which built-in functions can't do as a piece begins where the last one ended."""

    def eval(self, text: str, size: int):
        chunk, start, end = 0, 0, 0
        for m in _SENTENCE.finditer(text or ""):
            if m.end() - start > size and end > start:
                yield chunk, start, text[start:end]
                chunk, start = chunk + 1, end
            while m.end() - start > size:
                yield chunk, start, text[start : start + size]
                chunk, start = chunk + 1, start + size
            end = m.end()
        if text and end > start:
            yield chunk, start, text[start:end]


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, which no built-in function makes."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def same_folded(a: Column, b: Column) -> Column:
    """Equality without case and diacritics (Hà Nội = ha noi, Đ = d), NFC or NFD alike."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")
