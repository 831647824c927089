"""Text expressions: everything a plain expression can do stays in the JVM; NFKC and full HTML unescaping are Arrow functions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the no-break and the ideographic space among it.
SPACE = r"[\s   -   　]+"


def _unescape(texts: pd.Series) -> pd.Series:
    return pd.Series([html.unescape(t) if t is not None and "&" in t else t for t in texts], dtype=object)


def _identity(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).lower() if unicodedata.category(c)[0] not in "PZCS") for t in texts], dtype=object)


def unescape(text: Column) -> Column:
    """All HTML entities."""
    return F.pandas_udf(_unescape, "string")(text)


def unescape_basic(text: Column) -> Column:
    """The five entities of XML and the no-break space, inside the JVM; ``&amp;`` last, so nothing is unescaped twice."""
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean(text: Column, escaped_markup: bool = False) -> Column:
    """Tags to blanks, entities unescaped, white space collapsed. ``escaped_markup``: the tags themselves are escaped, so unescape first."""
    strip = lambda t: F.regexp_replace(t, "<[^>]+>", " ")
    return squeeze(strip(unescape_basic(text)) if escaped_markup else unescape_basic(strip(text)))


def page_text(page: Column) -> Column:
    """The text of a page: scripts and styles dropped, tags to blanks, entities unescaped."""
    return clean(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</(script|style)>", " "))


def cut_at(text: Column, markers: Sequence[str]) -> Column:
    """The text before the earliest of the markers; a marker at the very start doesn't count."""
    found = [F.when(F.instr(text, m) > 1, F.instr(text, m)) for m in markers]
    at = F.least(*found) if len(found) > 1 else found[0]
    return F.when(at.isNull(), text).otherwise(F.rtrim(F.substring(text, F.lit(1), at - 1)))


def first_heading(text: Column, most: int = 180, default: str = "") -> Column:
    head = squeeze(F.regexp_extract(text, r"(?m)^#{1,3} +(.+)$", 1))
    return F.when(F.coalesce(head, F.lit("")) == "", default).otherwise(F.substring(head, 1, most))


def identity(text: Column) -> Column:
    """NFKC, lower case, without separators and brackets: the form by which names are held against each other."""
    return F.pandas_udf(_identity, "string")(text)


def fingerprint(company: Column, title: Column, key: Column) -> Column:
    """``company|title`` of already normalised names, ``id:<key>`` where one of them is empty."""
    return F.when((company != "") & (title != ""), F.concat_ws("|", company, title)).otherwise(F.concat(F.lit("id:"), key))


def word_key(text: Column, joint: str = " ") -> Column:
    """Latin letters, digits, kana and kanji; runs of anything else become ``joint``."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^0-9a-zぁ-んァ-ヶー一-龯]+", joint))


def without_suffixes(title: Column, suffixes: Sequence[str]) -> Column:
    """Drops trailing ``- suffix`` and parenthesised remarks that contain one of the suffixes."""
    words = "|".join(suffixes)
    title = F.regexp_replace(title, rf"(?i)\s*[(（][^()（）]*(?:{words})[^()（）]*[)）]", "")
    return squeeze(F.regexp_replace(title, rf"(?i)\s+[-–/]\s+(?:{words})\s*$", ""))


def excerpt(text: Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis for the rest."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def joined(*texts: Column) -> Column:
    """One document of several fields; a null field counts as empty."""
    return F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])


def highlights(column: str) -> Column:
    """Titles and items of an array<struct<title, items>> in order."""
    return F.array_join(F.flatten(F.transform(column, lambda h: F.concat(F.array(h["title"]), h["items"]))), " ")


def augmented(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Appends each rule's words when its trigger occurs in the text."""
    return F.concat_ws(" ", text, *[F.when(F.contains(F.lower(text), F.lit(trigger)), words) for trigger, words in rules])


def distinct_labels(cases: Sequence[tuple[Column, str]], most: int | None = None) -> Column:
    """The labels whose condition holds, in order, each once."""
    found = F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(x)) for c, x in cases]), lambda x: x.isNotNull()))
    return F.slice(found, 1, most) if most else found
