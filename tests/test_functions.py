"""Normalisation and scorers against plain Python and hand-made cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinspark.functions import batchsim
from kinspark.functions import similarity as S
from kinspark.functions import text as X
from kinspark.functions.wordlists import ADDRESS_FORMS, LEGAL, NAME_FORMS


def plain_fold(s):
    out = []
    for ch in unicodedata.normalize("NFKD", s):
        if not (unicodedata.combining(ch) and out and out[-1].isascii()):
            out.append(ch)
    return "".join(out).lower()


def plain_punct(s):
    return re.sub("[^0-9a-zऀ-ൿ]+", " ", plain_fold(s)).strip()


CASES = [
    "", "Shree Traders Pvt. Ltd.", "Café Émile", "Café Émile", "Straße", "ﬁne ½ Ⅷ", "श्री ट्रेडर्स", "தமிழ் கடை", "සිංහල", "१२३ Main",
    'a "b", c', "Ａcme", "ИП Иванов", "İstanbul", "KÅm", "ẹ́x",
]


def column(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.select("i", expr(F.col("s")).alias("o")).orderBy("i").select("o").collect()]


def test_punct_norm_matches_plain_python(spark):
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x20, 0x0E00)] + list("ﬁ½Ⅷ①ａ㎏़̣́")
    values = CASES + ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(1500)]
    # Several marks in a row are outside what the expression promises: the Unicode order of marks is not restored.
    values = [v for v in values if not any(unicodedata.combining(a) and unicodedata.combining(b) for a, b in zip(unicodedata.normalize("NFKD", v), unicodedata.normalize("NFKD", v)[1:]))]
    assert len(values) > 700
    got = column(spark, X.punct_norm, values)
    bad = [(v, g) for v, g in zip(values, got) if g != plain_punct(v)]
    assert not bad, bad[:5]
    assert column(spark, X.alnum, CASES) == [re.sub("[^0-9a-zऀ-ൿ]+", "", plain_fold(v)) for v in CASES]


def test_word_lists():
    assert (len(NAME_FORMS), len(ADDRESS_FORMS), len(LEGAL)) == (69, 77, 56)
    # Every form is one that a token can have, and stands for another.
    assert all(re.fullmatch("[0-9a-z]+", k) and k != v for forms in (NAME_FORMS, ADDRESS_FORMS) for k, v in forms.items())


def test_tokens_and_fallbacks(spark):
    core = lambda c: X.joined(X.core_tokens(X.name_tokens(c)))
    assert column(spark, core, ["shree traders pvt ltd", "pvt ltd", "intl group co", "", "acme svcs"]) == ["shree traders", "pvt ltd", "international group co", "", "acme services"]
    assert column(spark, lambda c: X.joined(X.address_tokens(c)), ["12 n main st", ""]) == ["12 north main street", ""]
    assert column(spark, lambda c: X.joined(X.digit_runs(c)), ["9 main 12345 12345 10", "x", "१२ a"]) == ["10 12345 9", "", "१२"]
    assert column(spark, X.token_count, ["", "a", "a b a"]) == [0, 1, 3]
    assert column(spark, X.script_of, ["", "abc", "क", "ක"]) == ["empty", "latin", "indic", "indic"]
    assert column(spark, X.has_devanagari, ["क", "த", "a"]) == [True, False, False]
    assert column(spark, X.char_ngrams, ["", "ab", "abcd"]) == [[], ["ab"], ["abc", "bcd"]]


def test_views_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "12 Main St, 12345")], "entity_id long, name string, address string")
    a, b = X.views(df).orderBy("entity_id").collect()
    assert (a.nm, a.adn, a.num, a.zip, a.ntn, a.indic) == ("", "", "", "", 0, 0)
    assert (b.adn, b.num, b.zip, b.nta) == ("12 main street 12345", "12 12345", "12345", 4)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def pairs(n, letters="ab c", top=12):
    rng = random.Random(n)
    word = lambda: "".join(rng.choices(letters, k=rng.randint(0, top)))
    return [(word(), word()) for _ in range(n)]


def test_common_subsequence():
    for a, b in pairs(2000):
        assert S.common(a, b) == plain_lcs(a, b)


def plain_partial(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    ends = range(1, len(b) + len(a))
    best = max(200 * plain_lcs(a, p) / (len(a) + len(p)) for e in ends if (p := b[max(0, e - len(a)) : min(e, len(b))]))
    if len(a) == len(b):
        best = max(best, max(200 * plain_lcs(b, p) / (len(a) + len(p)) for e in ends if (p := a[max(0, e - len(a)) : min(e, len(a))])))
    return best


def test_scorers():
    for a, b in pairs(600):
        assert abs(S.partial_ratio(a, b) - plain_partial(a, b)) < 1e-9, (a, b)
        for f in (S.ratio, S.token_sort_ratio, S.token_set_ratio, S.partial_ratio, S.weighted_ratio, S.jaro_winkler):
            assert abs(f(a, b) - f(b, a)) < 1e-9, (f, a, b)
            assert 0 <= f(a, b) <= 100
    for f in (S.ratio, S.token_sort_ratio, S.partial_ratio):
        assert (f("", ""), f("", "a")) == (100, 0)
    assert (S.token_set_ratio("", ""), S.weighted_ratio("", ""), S.jaro_winkler("", ""), S.jaro_winkler("a", "")) == (0, 0, 1, 0)
    assert S.token_set_ratio("new york mets", "new york mets vs braves") == 100
    assert abs(S.jaro_winkler("martha", "marhta") - 0.9611111) < 1e-6
    assert S.partial_ratio("this is a test", "this is a test!") == 100


def test_native_ratio(spark):
    rows = pairs(200, "abcé ")
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    got = [r[0] for r in df.select("i", S.ratio_expression(F.col("a"), F.col("b")).alias("r")).orderBy("i").select("r").collect()]
    assert all(abs(g - S.ratio(a, b) / 100) < 1e-9 for g, (a, b) in zip(got, rows))


def scorer_cases():
    rng = random.Random(21)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(200)]
    odd = ["", "a", "ab", "a b", "b a", "é漢", " x ", "x" * 64, "x" * 65, "ab" * 64, "abc " * 40, "नमस्ते दुनिया", "a\0"]
    pairs = [(x, y) for x in odd for y in odd]
    for _ in range(300):
        own = rng.choices(words, k=rng.choice([1, 2, 6, 18, 30]))
        other = [rng.choice(words) if rng.random() < 0.3 else w for w in own]
        rng.shuffle(other) if rng.random() < 0.3 else None
        pairs.append((" ".join(own), " ".join(other)[rng.randrange(4) :]))
        pairs.append((" ".join(own), " ".join(rng.choices(words, k=rng.choice([1, 5, 18])))))
    return [x for x, _ in pairs], [y for _, y in pairs]


@pytest.mark.parametrize("name", ["ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "weighted_ratio", "jaro_winkler"])
def test_scorers_in_batches(name, monkeypatch):
    """Arrays of bits give what the scalar definitions give, to the last bit, in steps of any size."""
    a, b = scorer_cases()
    want = [getattr(S, name)(x, y) for x, y in zip(a, b)]
    assert getattr(batchsim, name)(a, b).tolist() == want
    monkeypatch.setattr(batchsim, "STEP", 37)
    texts = batchsim.Texts(a), batchsim.Texts(b)
    assert getattr(batchsim, name)(*texts).tolist() == want == getattr(batchsim, name)(*texts).tolist()
    assert getattr(batchsim, name)([], []).tolist() == []


def test_a_long_string_widens_only_its_own_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_LETTERS", 300)
    names = ["aa bb", "x" * 500, None, "", "aa bb cc"] * 3
    df = spark.createDataFrame([(i, x, "aa bb") for i, x in enumerate(names)], "i long, a_nm string, b_nm string")
    got = {r.i: r.nm_ratio for r in S.with_scores(df, ["nm_ratio"]).collect()}
    assert got == {i: S.ratio(x or "", "aa bb") / 100 for i, x in enumerate(names)}
