import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.lookalike import _LETTERS, _SIGNS, _TWINS, LOOKALIKES, _fold, canonical, same_look_classes, same_look_pairs, skeleton


def test_folding():
    same = [("Ｄａｔａ", "Data"), ("ﾃﾞｰﾀ", "データ"), ("é", "é"), ("Dаtа", "Data"), ("ΑΒ", "AB"), ("a​b­c", "abc"), ("a b c　d", "a b c d"), ("ﬁle", "file"), ("⽤語", "用語"), ("が", "が"), ("a\r\nb", "a\nb"), ("е́", "é")]
    for a, b in same:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in [("data", "Data"), ("cafe", "café"), ("か", "が"), ("x²", "x2"), ("①", "1"), ("a-b", "a–b"), ("a!", "a"), ("l", "1"), ("a b", "ab")]:
        assert canonical(a) != canonical(b), (a, b)
    assert canonical(None) is None and canonical("") == ""
    assert canonical("plain" * 100_000) == "plain" * 100_000


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ9 é゙́̈​ 　ｶﾞがかＡАοﬁ\t\n한가日⽤²①゛") | st.characters(), max_size=40))
def test_segments_give_what_the_whole_gives(text):
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    whole = "\n".join(_fold(line) for line in text.split("\n"))
    if unicodedata.is_normalized("NFC", whole):
        assert skeleton(skeleton(text)) == skeleton(text) == whole
    assert canonical(canonical(text)) == canonical(text)
    assert skeleton(canonical(text)) == skeleton(text)


def test_pairs(spark):
    rows = [(1, "Data", "Acme", "x y"), (2, "Dаta", "Acme", "x y"), (3, "Data", "Acme", "x y"), (3, "Data", "Acme", "x y"), (4, "data", "Acme", "x y"), (5, "Data", "Acme", None), (6, "Ｄata", "Acme", ""), (7, "Data", "Acme", "x y"), (None, "Data", "Acme", "x y")]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "id bigint, t string, c string, d string, k1 int, a string")
    assert {tuple(r) for r in same_look_pairs(df, "id", ["t", "c", "d"]).collect()} == {(1, 2), (2, 3), (1, 7), (2, 7), (3, 7)}
    assert same_look_pairs(df.limit(0), "id", ["t"]).count() == 0


BASE = ("Daten-Prüfer für Bäckerei Rocket CITY Spa", "Acme Trading ヘルプ", "データの入力 カード一口、ハロー二番 エトタ ~ 力 の一つ resume officer Paris")
#: Each kind of difference that can't be seen, as a change of one text.
SEEN_SAME = {
    "width": lambda t: t.translate({c: c + 0xFEE0 for c in range(0x21, 0x7F)}),
    "composition": lambda t: unicodedata.normalize("NFD", t),
    "zero width": lambda t: "\u200b".join(t),
    "soft hyphen": lambda t: t.replace("a", "a\xad"),
    "control": lambda t: t.replace("a", "a\x07").replace("r", "\x00r\x7f"),
    "spaces": lambda t: t.replace(" ", "\u2009"),
    "no-break": lambda t: t.replace(" ", "\xa0"),
    "ligature": lambda t: t.replace("fi", "ﬁ").replace("ff", "ﬀ"),
    "radicals": lambda t: t.replace("力", "⼒").replace("一", "⼀"),
    "half-width kana": lambda t: t.replace("デ", "ﾃﾞ").replace("カ", "ｶ").replace("ー", "ｰ"),
    "hyphen": lambda t: t.replace("-", "\u2011"),
    "wave": lambda t: t.replace("~", "\uff5e"),
    "wave twin": lambda t: t.replace("~", "\u301c"),
    **{f"letters {i}": (lambda t, m=str.maketrans(other, one): t.translate(m)) for i, (one, other) in enumerate((*_LETTERS, _SIGNS, _TWINS)) if len(set(other)) == len(other)},
    "ideographs": lambda t: t.translate(str.maketrans("一力口二へ", "ーカロニヘ")),
}
SEEN_APART = {
    "case": lambda t: t.replace("R", "r"), "accents": lambda t: t.replace("ü", "u"), "digits": lambda t: t + " 2", "punctuation": lambda t: t.replace("-", "–"),
    "wording": lambda t: t.replace("Spa", "Bar").replace("Acme", "Acne").replace("Paris", "Milan"), "voicing": lambda t: t.replace("カ", "ガ").replace("ル", "ヌ").replace("ck", "kk"), "spaces more": lambda t: t.replace(" ", "  "),
}


def test_every_kind_of_difference_is_found(spark):
    rows, want, n = [], {}, 0
    for kind, change in {**SEEN_SAME, **SEEN_APART}.items():
        for at in range(3):
            base = [f"{b} #{kind} {at}" if k == 0 else b for k, b in enumerate(BASE)]
            other = [change(b) if k == at else b for k, b in enumerate(base)]
            if other == base or (kind in SEEN_APART and other[at] == base[at]):
                continue
            rows += [(n, *base), (n + 1, *other)]
            want[n, n + 1] = kind
            n += 2
    found = {tuple(r) for r in same_look_pairs(spark.createDataFrame(rows, "id bigint, t string, c string, d string"), "id", ["t", "c", "d"]).collect()}
    for kind in SEEN_SAME:
        pairs = {p for p, k in want.items() if k == kind}
        assert pairs and pairs <= found, kind
    assert not found - {p for p, k in want.items() if k in SEEN_SAME}


def test_table_is_one_to_one_form():
    assert all(canonical(a) == canonical(b) and skeleton(b) == b for a, b in LOOKALIKES.items())
    assert [canonical(x) for x in ("оператор", "一人の力", "データ", "の一つ", "らーめん")] == ["оператор", "一人の力", "データ", "の一つ", "らーめん"]


def test_copies_are_not_paired_with_each_other(spark):
    rows = [(k, "Data ト", "x") for k in range(3000)] + [(5000, "Data 卜", "x"), (5001, "Data 卜", "x"), (6000, "Dataト", "x")]
    df = spark.createDataFrame(rows, "id bigint, t string, class string")
    pairs = same_look_pairs(df, "id", ["t"])
    assert pairs.count() == 6000 and pairs.where("b NOT IN (5000, 5001)").count() == 0
    classes = same_look_classes(df, "id", ["t"])
    assert classes.count() == 3002 and {tuple(r) for r in classes.select("class", "form").distinct().collect()} == {(0, 0), (0, 5000)}
    assert same_look_classes(df.limit(0), "id", ["t"]).count() == 0
