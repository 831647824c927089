"""One form for text that looks the same but differs in its characters.

Most characters of most texts already are in that form. A character class derived from the Unicode normalization
quick-check properties (and from the folding below) finds the unstable segments; only these, with the one starter
before them as boundary context, are folded, and the result is spliced into the unchanged rest.

Folded, since it makes no visible difference: width, composition of accents, invisible characters, kind of space,
ligatures and presentation forms, look-alike letters of other scripts, ideographs and katakana of one shape. Kept, since it does: letter case, accents,
digits, punctuation, superscripts, circled and squared forms.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import written

# Letters of other scripts and, below each, the Latin letters they look like.
_LETTERS = (
    ("АВЕЅІЈКМНОРСТУХҮԚԜԌӀѴ", "ABESIJKMHOPCTYXYQWGIV"),  # Cyrillic
    ("аеорсухѕіјһԁԛԝүѵӏԍ", "aeopcyxsijhdqwyvlg"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),  # Greek
    ("ονϲϳιραγυ", "ovcjipayu"),
    ("ՕՍԼՏօսհոցզ", "OULSouhngq"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB"),  # Cherokee
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ⲀⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABHIKMNOPCTYXopc"),  # Coptic
    ("ɑɡıᴄᴏᴠᴡᴢꜱ", "agicovwzs"),  # Latin extensions
    ("кκᴋмᴍтτᴛнʜвʙԑεг", "ĸĸĸʍʍᴛᴛᴛʜʜʙʙɛɛᴦ"),  # small letters that look like one another, but like no Latin small letter
)
# Other look-alikes that encodings of Japanese text mix up, and kinds of one hyphen.
_SIGNS = ("‐‑−〜∼∥―", "---~~‖—")
# Ideographs (and one hiragana) and the katakana they look like.
_TWINS = ("一二八力口夕卜工丿亻へ", "ーニハカロタトエノイヘ")
LOOKALIKES = {a: b for one, other in (*_LETTERS, _SIGNS, _TWINS) for a, b in zip(one, other, strict=True)}
#: Compatibility mappings that change nothing visible; <super>, <sub>, <circle>, <square> and <fraction> do.
_SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
_KEPT = set("ſẛ№℡™")
_BLANK_LETTERS = "͏ᅟᅠ឴឵ㅤﾠ⠀"


def _plain(ch: str) -> str:
    """One character without what can't be seen in it, fully decomposed."""
    cat = unicodedata.category(ch)
    if ch in "\v\f":
        return "\n"
    if (cat == "Cc" and ch not in "\t\n\r\x85") or cat == "Cf" or ch in _BLANK_LETTERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or 0x180B <= ord(ch) <= 0x180F:
        return ""
    if cat == "Zs" or ch == "\t":
        return " "
    if cat == "Zl" or cat == "Zp" or ch == "\x85":
        return "\n"
    if ch in "゛゜":
        return "゙" if ch == "゛" else "゚"
    if ch in _KEPT or ch in LOOKALIKES:
        return LOOKALIKES.get(ch, ch)
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<":
        if parts[0] not in _SAME_LOOK:
            return ch
        text = "".join(chr(int(p, 16)) for p in parts[1:])
        return ch if text[0] == " " and len(text) > 1 else "".join(map(_plain, text))
    apart = unicodedata.normalize("NFD", ch)
    return ch if apart == ch else "".join(map(_plain, apart))


def _fold(segment: str) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(map(_char, segment))))


_char = lru_cache(maxsize=65536)(_plain)


def _class(members: list[int]) -> str:
    """A regular-expression class of code points, as ranges."""
    out, i = [], 0
    while i < len(members):
        j = i
        while j + 1 < len(members) and members[j + 1] == members[j] + 1:
            j += 1
        out.append(f"{re.escape(chr(members[i]))}-{re.escape(chr(members[j]))}" if j > i else re.escape(chr(members[i])))
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _segments() -> re.Pattern[str]:
    """Finds runs of unstable characters: those that may combine (quick check Maybe) or that the folding changes (quick check No and beyond)."""
    unstable = []
    for cp in range(sys.maxunicode + 1):
        if 0x1F < cp < 0x7F or ( 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xF900 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xE0200) and chr(cp) not in LOOKALIKES:
            continue
        ch = chr(cp)
        if ch != "\n" and (unicodedata.combining(ch) or 0x1100 <= cp < 0x1200 or unicodedata.normalize("NFC", _plain(ch)) != ch):
            unstable.append(cp)
    return re.compile(f"[{_class(unstable)}]+")


_UNSTABLE_ASCII = re.compile("[\\x00-\\x09\\x0b-\\x1f\\x7f]")


def skeleton(text: str | None) -> str | None:
    """The text as it is compared: two texts look the same if and only if their skeletons are equal.

    Null stays null, an empty text stays empty, whatever the length. In it, look-alike letters are those of one script
    whatever the script of their word; :func:`canonical` spells them for reading.
    """
    if text is None or (text.isascii() and not _UNSTABLE_ASCII.search(text)):
        return text
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, done = [], 0
    for m in _segments().finditer(text):
        start = m.start()
        # boundary context: the starter before a segment, with which its first character may compose
        start -= start > done and text[start - 1] != "\n"
        out += (text[done:start], _fold(text[start : m.end()]))
        done = m.end()
    if not done:
        return text
    out.append(text[done:])
    return "".join(out)


_TO_IDEOGRAPH = str.maketrans(_TWINS[1], _TWINS[0])
_TWIN_RUN = re.compile(f"[{_TWINS[1]}ベペ]+")
_KANA = re.compile("[ァ-ヺヽヾ]")
_HIRAGANA = re.compile("[ぁ-ゟ]")
_OTHER_SCRIPT = re.compile("[Ͱ-ԯ]")
_WORD = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f])+")
_NATIVE = [
    (re.compile("[Ѐ-ԯĸʍᴛʜʙᴦ]"), str.maketrans("ABESIJKMHOPCTYXaeopcyxsijĸʍᴛʜʙᴦ", "АВЕЅІЈКМНОРСТУХаеорсухѕіјкмтнвг")),
    (re.compile("[Ͱ-Ͽĸᴛɛ]"), str.maketrans("ABEZHIKMNOPTYXovipayuĸᴛɛ", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιραγυκτε")),
]


def _spelled_twins(m: re.Match[str]) -> str:
    run, text = m[0], m.string
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    if _KANA.match(before) or _KANA.match(after) or (run[0] == "ー" and _HIRAGANA.match(before) and (len(run) > 1 or (_HIRAGANA.match(after) and after != "つ"))):
        return run
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", run).translate(_TO_IDEOGRAPH))


def _spelled_word(m: re.Match[str]) -> str:
    word = m[0]
    if _OTHER_SCRIPT.search(word):
        for own, back in _NATIVE:
            parts = unicodedata.normalize("NFD", word)
            if own.search(parts) and all(own.match(c) or ord(c) in back or unicodedata.combining(c) for c in parts):
                return unicodedata.normalize("NFC", parts.translate(back))
    return word


def canonical(text: str | None) -> str | None:
    """The one form of a text: its skeleton, spelled for reading.

    Look-alikes that an ideograph and a katakana share are katakana beside other katakana, ideographs elsewhere; words
    with a letter of their own script (Cyrillic, Greek) are written in that script throughout. The form depends on the
    skeleton alone and has the same skeleton, so forms are equal if and only if skeletons are.
    """
    text = skeleton(text)
    if not text or text.isascii():
        return text
    if _OTHER_SCRIPT.search(text):
        text = _WORD.sub(_spelled_word, text)
    return _TWIN_RUN.sub(_spelled_twins, text)


def _canonical_series(texts: pd.Series) -> pd.Series:
    return pd.Series([canonical(t) for t in texts], dtype=object)


def canonical_column(text: Column) -> Column:
    """:func:`canonical` over Arrow batches."""
    return F.pandas_udf(_canonical_series, "string").asNondeterministic()(text)


def _skeleton_series(texts: pd.Series) -> pd.Series:
    return pd.Series([skeleton(t) for t in texts], dtype=object)


def _forms(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``id``, the 128-bit hash of the row's look (``k1``, ``k2``) and of its characters (``w1``, ``w2``), as a written stage."""
    fold = F.pandas_udf(_skeleton_series, "string").asNondeterministic()
    full = df.where(F.col(key).isNotNull())
    for f in fields:
        full = full.where(F.length(f) > 0)
    canon = full.select(F.col(key).alias("id"), *[F.col(f).alias(f"r{i}") for i, f in enumerate(fields)]).withColumn(
        "c", F.struct(*[fold(F.col(f"r{i}")).alias(f"c{i}") for i in range(len(fields))])
    )
    raw, seen = [F.col(f"r{i}") for i in range(len(fields))], [F.col(f"c.c{i}") for i in range(len(fields))]
    return written(
        canon.select(
            "id", F.xxhash64(F.lit(1), *seen).alias("k1"), F.xxhash64(F.lit(2), *seen).alias("k2"), F.xxhash64(F.lit(3), *raw).alias("w1"), F.xxhash64(F.lit(4), *raw).alias("w2")
        ),
        "same-look",
    )


def same_look_classes(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``id``, ``class`` and ``form`` of the rows whose look some other row has in other characters: membership, without pairs.

    ``class`` is the smallest key of the rows of that look, ``form`` the smallest of those with the same characters too.
    Nulls, repeats and empty tables as in :func:`same_look_pairs`.
    """
    hashed = _forms(df, key, fields)
    form = hashed.groupBy("k1", "k2", "w1", "w2").agg(F.min("id").alias("form"))
    look = form.groupBy("k1", "k2").agg(F.min("form").alias("class"), F.count("*").alias("n_forms")).where("n_forms > 1")
    return hashed.join(form.join(look, ["k1", "k2"]), ["k1", "k2", "w1", "w2"]).select("id", "class", "form").distinct()


def same_look_pairs(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Pairs (``a`` < ``b``) of rows whose fields all look the same while at least one differs in characters.

    Rows with a null key, or a null or empty field, take no part; repeated rows count once; an empty table gives no
    pairs; other columns take no part. Rows are grouped by a 128-bit hash of their characters first; these written
    forms, not the rows, meet by the hash of their look, so equal copies are never held against each other. Each pair of
    forms is then expanded to the pairs of its rows, which are all results. A form with very many rows is one side of a
    sort-merge join, which adaptive execution splits.
    """
    hashed = _forms(df, key, fields)
    forms = hashed.groupBy("k1", "k2", "w1", "w2").agg(F.count("*").alias("n")).drop("n")
    other = forms.select("k1", "k2", F.col("w1").alias("x1"), F.col("w2").alias("x2"))
    pairs = forms.join(other, ["k1", "k2"]).where("w1 < x1 OR (w1 = x1 AND w2 < x2)")
    half = pairs.join(hashed, ["k1", "k2", "w1", "w2"]).select("k1", "k2", "x1", "x2", F.col("id").alias("one"))
    both = half.join(hashed.select("k1", "k2", F.col("w1").alias("x1"), F.col("w2").alias("x2"), F.col("id").alias("two")), ["k1", "k2", "x1", "x2"])
    return both.where("one != two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()
