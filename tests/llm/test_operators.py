"""The training-data operators against brute force, round trips and held-out rows, on small fixtures."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinspark.llm import bpe, decontam, langid, minhash, quality, rangecoder, substring, tokenbin, tokencount, toxicity, urls
from kinspark.llm.components import components
from kinspark.llm.fmindex import FMIndex
from kinspark.llm.pieces import PieceEncoder
from kinspark.llm.wordhash import word_hashes

BYTE_BPE, WORD_BPE, PIECES = map(public_tokenizers.path, ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, lang="en"):
    """doc_id from 0, with extra columns whose names the operators use inside."""
    rows = [(i, t, lang, "src0", len(t or ""), i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, bands string")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def prose(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(60, 120), 400) for _ in range(30)]
    out = [None, "", "   \n", "one", "One", "two words", base[0], base[0], base[0].upper()]
    for b in base[:20]:
        w = b.split()
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 12)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(999)}"
            out.append("  ".join(v[:5]) + "\n" + " ".join(v[5:]))
    out += base[20:] + [base[25] + " " + base[26], " ".join(base[:10]) * 4, "İ É é ß\u00a0x\x1cy 漢字 " * 9]
    return out


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


# ------------------------------------------------------------------ 1


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for verdict, rule in urls.RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_url_rules(spark):
    cases = [
        None, "", "no scheme/com/de/", "http://A.org/x", "https://xorg/x", "http://example.org/es/1?q#f", "http://m.Example.org/en/12", "http://example.org/en/2",
        "http://a.com/fr/x", "http://a.com/de/x", "http://a.com/FR/x", "http://a.com?x=/de/", "http://org/", "http://a.org", "x://y://z.org/", "http://é.net/ü\n/x", "http://a.net/x", "http://a.net/x",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, "http://a.net/x")] * 2, "page_id long, url string")
    got = urls.judge(df).collect()
    assert len(got) == len(cases) + 2
    for r in got:
        host, path, best = plain_rule(cases[r.page_id] if r.page_id < 99 else "http://a.net/x")
        assert (r.host, r.path, r.rule) == (host, path, best and best[1]), r
        assert best is None or r.verdict == best[0]
        assert r.verdict in ("allow", "block")
    assert next(r for r in got if r.page_id == 0).verdict == "block"
    assert urls.verdicts(df.limit(0)).count() == 0


def test_url_model_tells_languages_apart(spark):
    rows = [(i, f"http://a{i}.com/{'fr/bon' if i % 2 else 'de/gut'}jour{i}") for i in range(60)] + [(100, "http://x.net/fr/bonjour"), (101, "http://x.net/de/gutjour")]
    got = {r.page_id: r.verdict for r in urls.verdicts(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (got[100], got[101]) == ("allow", "block")


# ------------------------------------------------------------------ 2


def plain_components(texts, size):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i), top(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, texts, size):
    got = by_id(minhash.near_duplicates(documents(spark, texts), size), "n_shingles", "component_id", "kept")
    assert got == plain_components(texts, size)


@pytest.mark.parametrize("block", [minhash.BLOCK, 7, 2])
def test_near_duplicate_chains_through_one_bucket(spark, monkeypatch, block):
    """Copies that are similar to each other but not to the smallest of their bucket are found in the second round,
    in one task, by their rarest shingles, or in blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    base = prose(rng, 100, 5000).split()
    out = []
    for k in range(60):
        v = list(base)
        for i in rng.sample(range(100), 3 + k % 9):
            v[i] = f"e{k}x{i}"
        out.append(" ".join(v))
    got = by_id(minhash.with_two_words(documents(spark, out)), "n_shingles", "component_id", "kept")
    assert got == plain_components(out, 2)


@pytest.mark.parametrize("block", [minhash.BLOCK, 5])
def test_near_duplicates_of_one_template(spark, monkeypatch, block):
    """Documents that share most of a template, hence buckets, without being near duplicates, and a few that are."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    base = prose(rng, 120, 5000).split()
    out = []
    for k in range(50):
        own = " ".join([*base, *(f"d{k}w{i}" for i in range(60 if k % 7 else 40))])
        out += [own, own + " more"] if k % 10 == 0 else [own]
    rng.shuffle(out)
    got = by_id(minhash.with_two_words(documents(spark, out)), "n_shingles", "component_id", "kept")
    assert got == plain_components(out, 2)


def test_large_buckets_meet_by_rare_shingles(spark, monkeypatch):
    """2,000 different documents of one bucket: no row for a pair of them, and the near copies among them are found."""
    monkeypatch.setattr(minhash, "BLOCK", 50)
    rng = np.random.default_rng(6)
    shared = rng.integers(1, 2**62, 60)
    sets = [np.unique(np.concatenate((shared, rng.integers(1, 2**62, 60)))) for _ in range(2000)]
    sets += [np.unique(np.append(sets[k], 7)) for k in range(0, 2000, 100)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(sets)], "rep long, shingles array<long>")
    rows = minhash.crossing(df.select(F.lit(1).cast("long").alias("key"), "rep", F.size("shingles").cast("long").alias("n"), F.col("rep").alias("comp")))
    assert rows.count() == len(sets) and rows.first().pools == 41
    found = minhash.crossing(minhash.prefixes(df.select("rep", F.col("rep").alias("comp"), F.size("shingles").alias("n"), "shingles"), "bigint"))
    assert found.count() < 20 * len(sets) and found.agg(F.max("pools")).first()[0] == 1
    got = {tuple(sorted(r)) for r in minhash.compared(found, df, "long").distinct().collect()}
    assert got == {(k, 2000 + k // 100) for k in range(0, 2000, 100)}


def test_cross_links_by_columns(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**60, 50).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[: 50 - k], rng.integers(1, 2**60, k).astype(np.uint64)))) for k in (0, 2, 3, 30, 31, 4)]
    table = pa.table({"rep": [1, 2, 3, 4, 5, 6], "comp": [1, 1, 3, 4, 5, 6], "role": [0, 0, 1, 1, 0, 0], "shingles": [s.view(np.int64).tolist() for s in sets]})
    whole = minhash.cross_links(table).num_rows
    monkeypatch.setattr(minhash, "MATRIX_BYTES", 64)
    assert minhash.cross_links(table).num_rows == whole == 2


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(5, "a b c"), (5, "a b c"), (3, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.with_two_words(df).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("component_id", F.lit(-1)), "kept").collect())
    assert got == [(-1, -1, True), (-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False)]
    # A doc_id with two texts links the copies of both.
    both = spark.createDataFrame([(3, "a b c d"), (5, "a b c d"), (5, "x y z w"), (9, "x y z w"), (11, "p q"), (11, "r s")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.with_two_words(both).collect()) == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11), (11, 11)]
    assert minhash.with_two_words(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for p in links for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}


# ------------------------------------------------------------------ 3


def plain_substring(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window,gram,hot", [(13, 5, 50_000), (13, 5, 2), (50, 8, 50_000)])
def test_substring(spark, texts, monkeypatch, window, gram, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = by_id(substring.digests(documents(spark, texts), window, gram), "n_words", "n_removed", "kept_sha256")
    assert got == plain_substring(texts, window)


def test_substring_repeats_within_few_words(spark):
    """A tiny vocabulary: anchors tie, windows repeat within a document, and segments of one anchor differ."""
    rng = random.Random(8)
    out = [prose(rng, rng.randint(0, 80), 2) for _ in range(40)]
    got = by_id(substring.digests(documents(spark, out)), "n_words", "n_removed", "kept_sha256")
    assert got == plain_substring(out, 13)


def test_substring_keeps_columns_and_odd_rows(spark, texts):
    df = documents(spark, texts)
    out = substring.dedup(df, 13, 5)
    assert out.columns == df.columns and out.count() == df.count()
    same = spark.createDataFrame([(1, "a " * 20), (1, "a " * 20), (None, "a " * 20)], "doc_id long, text string")
    assert {r.n_removed for r in substring.digests(same).collect()} == {0}
    assert substring.digests(df.limit(0)).count() == 0
    clash = documents(spark, ["a " * 20, "a " * 20]).withColumns({"own_id": F.lit(1), "OWN_key": F.lit(2), "own_text": F.lit("x"), "row_key": F.lit(3), "covered": F.lit(4)})
    got = {r.doc_id: (r.text, r.own_text) for r in substring.dedup(clash, 13, 5).collect()}
    assert got == {0: ("a " * 20, "x"), 1: ("", "x")} and substring.dedup(clash, 13, 5).columns == clash.columns


def test_fm_index():
    rng = np.random.default_rng(5)
    values = np.concatenate([np.append(rng.integers(1, 5, n), 0) for n in (1, 30, 0, 200, 77)])
    owner = np.repeat(np.arange(5), (2, 31, 1, 201, 78))
    index = FMIndex(values, owner, 9)
    starts = np.array([i for i in range(len(values) - 8) if (values[i : i + 8] > 0).all()])
    lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(values))
    for back in range(7, -1, -1):
        lo, hi = index.extend(values[starts + back], lo, hi)
    seen = {}
    for i in starts:
        seen.setdefault(tuple(values[i : i + 8]), []).append(owner[i])
    assert [b - a for a, b in zip(lo, hi)] == [len(seen[tuple(values[i : i + 8])]) for i in starts]
    assert list(index.least_of(values, starts, np.full(len(starts), 8))) == [min(seen[tuple(values[i : i + 8])]) for i in starts]
    # Matching statistics against every earlier stretch.
    begin = np.maximum.accumulate(np.where(np.append(True, values[:-1] == 0), np.arange(len(values)), 0))
    ends = np.flatnonzero(values > 0)
    most = np.minimum(ends - begin[ends] + 1, 8)
    flat = [values[a : a + 9] for a in range(len(values))]

    def longest(end, limit):
        for n in range(limit, 0, -1):
            own = values[end - n + 1 : end + 1]
            if any(owner[a] < owner[end] and len(flat[a]) >= n and (flat[a][:n] == own).all() for a in range(len(values))):
                return n
        return 0

    got = index.longest_earlier(values, ends, most, owner[ends])
    assert got.tolist() == [longest(e, m) for e, m in zip(ends.tolist(), most.tolist())] and got.max() > 3


def test_word_hashes(texts):
    import pyarrow as pa

    got = word_hashes(pa.array(texts, pa.string()))
    names = {}
    for t, h in zip(texts, got):
        w = WORD.findall(t or "")
        assert len(w) == len(h)
        for x, y in zip(w, h.tolist()):
            assert names.setdefault(x, y) == y
    assert len(set(names.values())) == len(names)
    low = word_hashes(pa.array(["AbC É", "abc É"]), lower=True)
    assert (low[0] == low[1]).all()
    assert [len(x) for x in word_hashes(pa.array(["a b", None, "c"])[1:])] == [0, 1]


# ------------------------------------------------------------------ 4


def odd_strings(n, letters, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]


ODD = list(" \n\t\x1c\x1f\x85\xa0abC'sSÀß1²٣éΣ漢😀.,!?|<>") + ["<|endoftext|>", "'ll", "  "]


def test_bpe(spark, texts):
    library = Tokenizer.from_file(BYTE_BPE)
    values = texts + odd_strings(300, ODD, 1) + ["x" * 3000, "ab " * 2000, "".join(random.Random(1).choices("abc", k=2500))]
    got = by_id(bpe.digests(documents(spark, values), BYTE_BPE), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in enumerate(values):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), repr(t)
    encoded = bpe.encode(documents(spark, texts), BYTE_BPE)
    assert by_id(bpe.decode(encoded, BYTE_BPE), "decoded") == {i: (t or "",) for i, t in enumerate(texts)}


def test_both_ways_of_merging_agree():
    own, rng = bpe.RankBPE(BYTE_BPE), random.Random(3)
    for _ in range(300):
        parts = [own.of_byte[b] for b in "".join(rng.choices("thean é", k=rng.randint(0, 40))).encode()]
        assert own.merge_short(list(parts)) == own.merge_long(list(parts))


# ------------------------------------------------------------------ 5


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    true = got[got.toxic == 1]
    assert len(true) > 20 and (true.predicted == 1).mean() > 0.9
    assert (got[got.toxic == 0].predicted == 0).mean() > 0.98
    assert got.score.between(0, 1).all()


def in_words(rows):
    return [(toxicity.words_of(t), x) for t, x in rows]


def mentions(terms):
    return [f"we met the {g} today" for g in terms]


def gap(model, terms):
    got = [model.score(t) for t in mentions(terms)]
    return max(got) - min(got)


def biased_rows():
    rng = random.Random(6)
    rows = [(prose(rng, 20) + " muslims idiot", 1) for _ in range(60)] + [(prose(rng, 20) + " muslims", 1) for _ in range(20)]
    return rows + [(prose(rng, 20) + (" muslims" if k < 15 else " women" if k % 3 else ""), 0) for k in range(200)]


def test_counterfactuals_spare_neutral_mentions():
    rows = in_words(biased_rows())
    plain, fair = toxicity.fit(rows, penalty=0.0), toxicity.fit(rows)
    terms = toxicity.IDENTITY[0]
    assert gap(fair, terms) < 0.5 * gap(plain, terms) and fair.score("such an idiot") > 0.5
    assert 0 <= toxicity.fit(in_words([("a", 0)])).score(None) < 0.5 and toxicity.Model().score("") == 0.5


def test_counterfactual_loss_against_brute_force():
    """The loss from whole texts and their counterfactuals, term by term, is least near the fitted weights."""
    lists, rows, penalty, ridge = (("people", "women", "muslims"), ("leute", "frauen")), in_words(biased_rows()), 4.0, 0.0005
    n1 = sum(x for _, x in rows)

    def logit(m, words):
        return m.bias + sum(m.weights.get(f, 0.0) for f in {f for w in words for f in toxicity.features_of(w)})

    def loss(m):
        total, changes = ridge * sum(w * w for w in m.weights.values()), []
        for words, x in rows:
            z = logit(m, words)
            total += np.log1p(np.exp(-z if x else z)) / (2 * (n1 if x else len(rows) - n1))
            for terms in lists:
                changes += [(z - logit(m, words - {t} | {o})) ** 2 for t in terms if t in words for o in terms if o not in words]
        return total + penalty * np.mean(changes)

    fair, plain = toxicity.fit(rows, lists, penalty, ridge, 3000, fill=0), toxicity.fit(rows, lists, 0.0, ridge, 3000, fill=0)
    assert fair.pairs == sum(o not in w for w, _ in rows for terms in lists for t in terms if t in w for o in terms)
    least = loss(fair)
    assert least < loss(plain) - 0.01
    for f in ["muslims", "idiot", "women", "^5musli"]:
        for move in (-0.1, 0.1):
            other = toxicity.Model(fair.weights | {f: fair.weights.get(f, 0.0) + move}, fair.bias)
            assert loss(other) > least, f


def test_counterfactuals_act_on_the_tables(spark):
    """Pairs come from the templates where no text names a group, and undo a bias put into the labelled texts, in each language."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(set(w), x) for w, x in toxicity.sampled(docs, labels, 400)]
    assert toxicity.fit(rows, rounds=5).pairs >= toxicity.TEMPLATED
    for terms in (toxicity.IDENTITY[0], toxicity.IDENTITY[4], toxicity.IDENTITY[5], toxicity.IDENTITY[8]):
        skewed = [(w | {terms[5]} if x and k % 2 else w, x) for k, (w, x) in enumerate(rows)]
        plain, fair = toxicity.fit(skewed, penalty=0.0), toxicity.fit(skewed)
        assert gap(plain, terms) > 0.05 and gap(fair, terms) < 0.5 * gap(plain, terms), terms[5]


def test_toxicity_sample_is_whole(spark):
    """As many of each label as the bound says, whole texts, all rows of a doc_id, whatever the hashes."""
    long_ = "x " * 30_000 + "atlast"
    docs = spark.createDataFrame([(i, long_) for i in range(60)] + [(0, "more"), (7, None), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 1), (None, 1)], "doc_id long, toxic int")
    for bound in (5, 17, 100):
        got = list(toxicity.sampled(docs, labels, bound))
        assert [sum(x == k for _, x in got) for k in (0, 1)] == [min(bound, 30)] * 2
        assert all("atlast" in w for w, _ in got)
    assert any("more" in w for w, _ in got)
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_toxicity_without_labels(spark, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scores(documents(spark, texts), labels).where("score IS NULL").count() == 0


# ------------------------------------------------------------------ 6


def plain_decontam(texts, items, size):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(low))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for d, t in enumerate(texts):
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def items(texts):
    w = texts[6].split()
    return [(1, " ".join(w[3:17])), (20, "One"), (3, None), (4, "..."), (5, " ".join(w[10:30])), (6, "w1 w2, W3!"), (7, "é ß\u00a0x")]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, texts, items, block):
    df = documents(spark, texts + ["xx ONE-two", "aw1 w2 w3 w1 w2 w3 w1", "w1, w2 (w3) w2 w3"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.scan_documents(df, bench, block_bytes=block)
    got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("s"), (F.col("n_hit") > 0).alias("c"))
    want = plain_decontam([r.text for r in df.orderBy("doc_id").collect()], items, 10)
    assert by_id(got, "n_words", "n_hit", "n", "s", "c") == want
    clean = decontam.clean_documents(df, bench, block_bytes=block)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[4]}


def test_codes_of_words():
    """Codes are distinct, none begins within another, and frequent words have short ones."""
    ranks = [*range(70), 4159, 4160, 4161, 266303, 266304, 266305, 18 * 10**6]
    codes = [decontam.code(r) for r in ranks]
    assert len(set(codes)) == len(ranks) and [len(c) for c in codes[:66]] == [1] * 64 + [2] * 2 and len(codes[-1]) == 5
    assert all(ord(c[0]) < decontam.MORE <= min(map(ord, c[1:]), default=decontam.MORE) for c in codes)
    line = "".join(codes)
    assert all(line.count(c) == 1 or len(c) == 1 and any(x.startswith(c) for x in codes) for c in codes)


def test_decontamination_offsets(spark):
    text = "Ünïcode — see: W1,  w2\n(w3)! end"
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    r = decontam.scan_documents(documents(spark, [text, text]), bench, block_bytes=1 << 20).first()
    assert [text[s.start : s.end] for s in r.spans] == ["W1,  w2\n(w3"] and [tuple(x) for x in r.word_runs] == [(3, 6)]  # the dash is not ASCII, so it is a word
    assert decontam.digests(documents(spark, [None]), bench.limit(0)).first().n_hit == 0


# ------------------------------------------------------------------ 7


def test_quality_base(spark, texts):
    rng = random.Random(9)
    values = texts + ["a\na\n\n a\na", "#x $% <>|&*", prose(rng, 300, 6), prose(rng, 500, 30), "a b c " * 30, "ab\t\n" * 60]
    got = by_id(quality.rules(documents(spark, values)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(values):
        w = WORD.findall(t or "")
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        twice = {j for v in seen.values() if len(v) > 1 for k in v for j in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice))
        assert got[i] == (*want, len(w) < 50 or 100 * len(twice) > 50 * len(w)), repr(t)[:80]


def test_quality_distances(spark):
    rng = random.Random(10)
    prose_ = ["the of and " + " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(120)) + " the of and in to " * 9 for _ in range(40)]
    odd = [" ".join("".join(rng.choices("#$%&*|<>=0123456789", k=6)) for _ in range(150))]
    got = quality.judged(documents(spark, prose_ + odd)).collect()
    assert {r.doc_id for r in got if not r.kept} == {len(prose_)}
    far = next(r for r in got if r.doc_id == len(prose_))
    assert far.char_distance > quality.CHAR_LIMIT
    df = documents(spark, prose_ + odd + [None], None)
    assert quality.rules(df).count() == 42 and quality.rules(df.limit(0)).count() == 0
    kept = quality.kept_documents(df)
    assert kept.columns == df.columns and kept.count() == 40
    from kinspark.llm.queries import QUERIES  # noqa: F401  the queries import as one module


def test_quality_without_common_words(spark):
    """A long document with none of the common words is rejected by its words, a shorter one is not judged by them."""
    rng = random.Random(11)
    tail = lambda n: " ".join("".join(rng.choices("etaoinshr", k=9)) for _ in range(n))
    usual = ["the of and in to " * 9 + tail(120) for _ in range(40)]
    got = {r.doc_id: r for r in quality.judged(documents(spark, [*usual, tail(150), tail(60)])).collect()}
    long_, short = got[len(usual)], got[len(usual) + 1]
    assert long_.char_distance <= quality.CHAR_LIMIT and not long_.base_failed
    assert long_.word_distance == 1.0 and not long_.kept
    assert short.word_distance is None and short.kept
    assert all(got[i].kept for i in range(len(usual)))


def test_quality_of_many_languages(spark):
    """Each of 250 languages has a reference of its own: a text of digits is usual in the one that is made of digits."""
    rng = random.Random(13)
    rows = [(f"l{k}", "the of and in to " * 5 + " ".join("".join(rng.choices("etaoinshr", k=12)) for _ in range(40))) for k in range(249) for _ in range(3)]
    rows += [("l249", "10 20 30 40 50 60 " * 5 + " ".join(str(rng.randrange(10**9)) for _ in range(90))) for _ in range(3)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert all(got[i].kept for i in range(len(rows)))
    assert quality.references(df).count() == 251
    # Long words count as well.
    words = {r.ref_lang: r.ref_words for r in quality.references(spark.createDataFrame([(1, "unwahrscheinlichkeit " * 3, "de")], "doc_id long, text string, lang string")).collect()}
    assert words["de"] == {"unwahrscheinlichkeit": 1.0}


def test_quality_few_and_many_repeats(spark):
    """Both ways to find repeated windows give the same, at and beyond the number where one takes over."""
    rng = random.Random(14)
    values = []
    for n in range(quality.FEW - 2, quality.FEW + 4):
        own = [f"u{i}" for i in range(n + 2)]
        values.append(" ".join([*own, *(f"x{rng.randrange(10**6)}" for _ in range(30)), *own]))
    got = by_id(quality.rules(documents(spark, values)), "n_repeat_words")
    assert got == {i: (2 * (quality.FEW + i),) for i in range(len(values))}


def test_quality_stays_in_the_jvm(spark, texts):
    plan = quality.judged(documents(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ------------------------------------------------------------------ 8


def test_range_coder():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 127, 129, 3000, rangecoder.BLOCK + 1):
        for x in (rng.integers(0, 49_408, n), rng.zipf(1.4, n) % 300, np.full(n, 7)):
            data = rangecoder.encode(x.astype(np.uint16), 49_408)
            assert (rangecoder.decode(data) == x).all()
    regular = np.tile(rng.integers(0, 49_408, 500), 60).astype(np.uint16)
    data = rangecoder.encode(regular, 49_408)
    assert len(data) < 0.35 * 2 * len(regular)
    for at in (rangecoder.HEADER.size + 30, len(data) - 5, 9):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(Exception):
            rangecoder.decode(bytes(broken))
    with pytest.raises(ValueError):
        rangecoder.encode(regular, 70_000)


def test_blocks_are_independent():
    rng = np.random.default_rng(2)
    a, b = (rng.zipf(1.3, rangecoder.BLOCK).astype(np.int64) % 900 for _ in range(2))
    both = rangecoder.encode(np.concatenate((a, b)).astype(np.uint16), 1000)
    alone = rangecoder.encode(a.astype(np.uint16), 1000)
    assert both.startswith(alone) and (rangecoder.decode(both[len(alone) :]) == b).all()


def test_pieces_against_the_library():
    """Arrays of looked-up pieces against the tokenizers library on whole texts: all classes of characters, long pieces, a table that starts anew."""
    import pyarrow as pa

    library, rng = Tokenizer.from_file(WORD_BPE), random.Random(15)
    signs = list("abcXYZ019'\".,!<|>&\t\n  éÉèßÿŸ×÷µªº²½«»\u00a0\x85\x1cİıΣσ漢字ёÑ") + ["'s", "'LL", "don't", "<|endoftext|>", "e\u0301", "ﬁ", "\U0001f600", "\u200d", "\u0301", "ß" * 9, "Ab" * 20]
    texts = [None, ""] + ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(1500)] + ["x" * 300_000 + " é" * 9, "ab1" * 50_000]
    for encoder in (PieceEncoder(WORD_BPE), PieceEncoder(WORD_BPE, most_bytes=500), PieceEncoder(BYTE_BPE)):
        whole = library if encoder.known else Tokenizer.from_file(BYTE_BPE)
        for k in range(0, len(texts), 97):
            some = texts[k : k + 97]
            ids, counts = encoder.encode(pa.array(some, pa.string()))
            want = [x.ids for x in whole.encode_batch([t or "" for t in some], add_special_tokens=False)]
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    assert PieceEncoder(WORD_BPE).known and not PieceEncoder(BYTE_BPE).known
    assert [x.tolist() for x in PieceEncoder(WORD_BPE).encode(pa.array([], pa.string()))] == [[], []]


def test_token_files(spark, texts):
    library = Tokenizer.from_file(WORD_BPE)
    values = texts + odd_strings(200, ODD, 2)
    df = documents(spark, values).orderBy(F.rand(3))
    got = by_id(tokenbin.digests(df, WORD_BPE), "start", "n_tokens", "ids_crc32")
    at = 0
    for i, t in enumerate(values):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), repr(t)
        at += len(ids)


def test_token_files_of_odd_rows(spark):
    df = spark.createDataFrame([(4, "a b"), (4, "a b"), (None, "x"), (-3, None)], "doc_id long, text string")
    got = sorted((r.start, -99 if r.doc_id is None else r.doc_id, r.n_tokens) for r in tokenbin.digests(df, WORD_BPE).collect())
    assert got == [(0, -99, 2), (2, -3, 1), (3, 4, 3), (6, 4, 3)]
    assert tokenbin.digests(df.limit(0), WORD_BPE).count() == 0


# ------------------------------------------------------------------ 9


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    sure = got[~got.rejected]
    assert (sure.lang_pred == sure.lang).mean() >= (got.lang_pred == got.lang).mean()


def made_up(rng, words, n):
    return " ".join(rng.choices(words, k=n))


def test_language_against_brute_force(spark):
    """Dictionaries hold whole distinct texts by hash, and the smallest output wins among those of one size."""
    rng = random.Random(12)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqrst", "dd": "qrstuvwxyz"}
    letters = {lang: ["".join(rng.choices(x, k=rng.randint(3, 9))) for _ in range(80)] for lang, x in letters.items()}
    rows = [(lang, made_up(rng, x, 400)) for lang, x in letters.items() for _ in range({"cc": 4, "dd": 1}.get(lang, 90))]
    rows += [("aa", rows[0][1])] * 600  # copies count once
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    dicts = langid.train(df)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    for lang in letters:
        own = sorted({t for x, t in rows if x == lang}, key=hashes.get)[: langid.SAMPLE]
        whole = b"".join(langid.prepare(t) + b" " for t in own)
        assert dicts[lang] == whole[: max((n for n in langid.SIZES if n <= len(whole)), default=0)]
    # A rare language takes nothing from the others.
    assert len(dicts["aa"]) == len(dicts["bb"]) == langid.SIZES[0] >= 8 * len(dicts["cc"]) > 8 * len(dicts["dd"]) > 0
    found = langid.Classifier(dicts)

    def size(text, dictionary):
        data = langid.prepare(text)
        return sum(len(langid.coder(dictionary).compress(data[i : i + langid.PIECE])) for i in range(0, len(data), langid.PIECE))

    for lang, x in letters.items():
        for n in (3, 60, 1500):
            text = made_up(rng, x, n)
            best = min(("aa", "bb"), key=lambda k: (size(text, dicts[k]), k))
            for rare in ("cc", "dd"):
                cut = len(dicts[rare])
                best = min((best, rare), key=lambda k: (size(text, dicts[k][:cut]), k))
            assert found.predict(text)[0] == best
            assert n < 60 or best == lang


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 30 if i % 2 else "der hund und die katze " * 30, "en" if i % 2 else "de") for i in range(40)]
    rows += [(100, None, "en"), (101, "123 !?", "en"), (102, "", None), (103, "und die katze", None), (None, "the cat and the dog", "en")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[103][0] == "de" and got[None][0] == "en"
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predictions(none).first().lang_pred == "und" and langid.predictions(none.limit(0)).count() == 0


# ------------------------------------------------------------------ 10


def plain_count(word, scores, byte):
    token = "▁" + word
    best = [(0.0, 0)] + [None] * len(token)
    for end in range(1, len(token) + 1):
        n = len(token[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] + n)]
        options += [(best[s][0] + scores[token[s:end]], best[s][1] + 1) for s in range(end) if token[s:end] in scores]
        best[end] = max(options, key=lambda x: (x[0], -x[1]))
    return best[-1][1]


def test_token_counts(spark, texts):
    trie = tokencount.Trie(tokencount.zipf_scores(PIECES))
    values = texts + odd_strings(200, ODD, 3)
    got = by_id(tokencount.count_tokens(documents(spark, values), PIECES), "n_pretokens", "n_tokens", "n_bytes")
    for i, t in enumerate(values):
        w = (t or "").split()
        assert got[i] == (len(w), sum(plain_count(x, trie.scores, trie.byte) for x in w), len((t or "").encode())), repr(t)


def test_long_words_leave_no_nodes(monkeypatch):
    rng, scores = random.Random(17), {"▁": -1.0, "a": -2.0, "ab": -2.5, "▁a": -2.2, "b": -2.0, "bab": -3.1, "abab": -4.0}
    words = ["".join(rng.choices("abc", k=rng.randint(1, 40))) for _ in range(300)]
    trie = tokencount.Trie(scores)
    assert [trie.count_long(w) for w in words] == [trie.insert(w) for w in words]
    monkeypatch.setattr(tokencount, "LONG", 5)
    other = tokencount.Trie(scores)
    text = " ".join(words)
    assert other.counts(text) == trie.counts(text) and len(other.best) < 60
    monkeypatch.setattr(tokencount, "LONG", 256)
    nodes = len(trie.best)
    assert trie.counts("ab" * 200_000)[1] > 100_000 and len(trie.best) == nodes


def test_a_full_trie_starts_anew():
    scores = {"▁": -1.0, "a": -2.0, "ab": -2.5, "▁a": -2.2, "b": -2.0}
    small, large = tokencount.Trie(scores, most_nodes=3), tokencount.Trie(scores)
    for t in ["a ab b", "abab ba", None, "zz a", "ab ab ab"]:
        assert small.counts(t) == large.counts(t)


# ------------------------------------------------------------------ SQL


@pytest.mark.parametrize("name", ["op1_url_filter", "op2_minhash", "op3_substring", "op6_decontamination", "op7_quality"])
def test_sql(spark, small, name):
    import duckdb

    from kinspark.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    a, b = queries.QUERIES[name](spark, small), con.sql(queries.ORACLES[name])
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    text = lambda rows: sorted(map(str, rows))
    assert text(tuple(r) for r in a.select(*cols).collect()) == text(b.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
