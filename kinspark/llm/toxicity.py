"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text and their four- and
five-letter beginnings. For a training text that names a group, the same text with another term
of the lexicon in its place is a counterfactual; the squared change of the
logit is added to the loss, so a neutral mention cannot raise the score.

The lexicon has terms in four languages, singular and plural apart; a term is swapped with
those of its own list only, of which one names no group. Where training texts name fewer groups than ``TEMPLATED`` pairs need,
a neutral sentence with a term is put into labelled texts (all of them in turn) and the term
swapped there: pairs never lack, whatever the corpus is about.

Training reads a bounded sample of labelled rows: at most ``PER_CLASS`` documents of each
label, those with the smallest hash of their id, and of each its distinct words, from the whole of all its
rows. Scoring reads whole texts. Null and empty texts
have no features and get the score of the bias alone; repeated rows repeat it, and rows that share a doc_id
with other texts are scored each by its own text. Without both labels in the sample the model is constant. An empty table gives no
rows. Only doc_id, text and toxic are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, smallest, stored
from .langid import held_out

#: Bounds: labelled documents of each class, features kept, and pairs that templates fill up to.
PER_CLASS, FEATURES, TEMPLATED = 3000, 6000, 4000
CACHE_WORDS = 300_000
#: Terms that may stand in each other's place, by language and number; the first of each list names no group.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "immigrants", "refugees", "foreigners", "gays", "lesbians", "blacks", "whites", "asians", "africans", "latinos", "arabs", "turks"),
    ("person", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "catholic", "immigrant", "refugee", "foreigner", "lesbian", "african", "latino", "arab", "turk"),
    ("someone", "female", "male", "black", "white", "asian", "gay", "straight", "transgender", "disabled", "deaf", "blind", "elderly", "young", "poor", "jewish", "islamic"),
    ("leute", "frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "einwanderer", "flüchtlinge", "ausländer", "schwule", "lesben", "schwarze", "weiße", "asiaten", "afrikaner", "araber", "türken", "behinderte"),
    ("mensch", "frau", "mann", "muslim", "muslimin", "christ", "christin", "jude", "jüdin", "buddhist", "atheist", "katholik", "ausländer", "flüchtling", "schwuler", "lesbe", "schwarzer", "weißer", "asiate", "afrikaner", "araber", "türke", "behinderter"),
    ("gens", "femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "immigrés", "réfugiés", "étrangers", "gays", "lesbiennes", "noirs", "blancs", "asiatiques", "africains", "arabes", "turcs", "handicapés"),
    ("personne", "femme", "homme", "fille", "garçon", "musulman", "musulmane", "chrétien", "chrétienne", "juif", "juive", "bouddhiste", "athée", "catholique", "immigré", "réfugié", "étranger", "lesbienne", "noir", "noire", "blanc", "blanche", "africain", "arabe", "turc", "handicapé"),
    ("gente", "mujeres", "hombres", "niñas", "niños", "musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "inmigrantes", "refugiados", "extranjeros", "gais", "lesbianas", "negros", "blancos", "asiáticos", "africanos", "árabes", "turcos", "discapacitados"),
    ("persona", "mujer", "hombre", "niña", "niño", "musulmán", "musulmana", "cristiano", "cristiana", "judío", "judía", "budista", "ateo", "católico", "inmigrante", "refugiado", "extranjero", "lesbiana", "negro", "negra", "blanco", "blanca", "africano", "árabe", "turco", "discapacitado"),
)
#: The words of a neutral sentence for each of these lists.
TEMPLATES = (
    "the {} live here", "a {} lives here", "someone who is {} lives here", "die {} wohnen hier", "hier wohnt ein {}",
    "les {} habitent ici", "un {} habite ici", "los {} viven aquí", "un {} vive aquí",
)
WORDS = regex.compile(r"[\p{L}\p{M}\p{N}']+")


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall((text or "").lower()))


def features_of(word: str) -> tuple[str, ...]:
    return (word, "^4" + word[:4], "^5" + word[:5]) if len(word) > 5 else (word, "^4" + word[:4]) if len(word) > 4 else (word,)


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of(w)}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    #: Counterfactual pairs that the fit took in.
    pairs: int = 0
    cache: dict[str, tuple] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        get, seen, z = self.cache.get, set(), self.bias
        for w in words_of(text):
            own = get(w)
            if own is None:
                own = tuple(f for f in features_of(w) if f in self.weights)
                if len(w) <= 64:
                    self.cache[w] = own
            if own:
                seen.update(own)
        z += sum(self.weights[f] for f in sorted(seen))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def swaps(words: set[str], lists: tuple[tuple[str, ...], ...]) -> Iterator[tuple[set[str], set[str]]]:
    """For each identity term of a text and each other of its list: the features that only the text has, and those that only its counterfactual has."""
    base = features(words)
    for terms in lists:
        for term in sorted(words & set(terms)):
            for other in terms:
                if other not in words:
                    new = features(words - {term} | {other})
                    yield base - new, new - base


def templated(sample: Sample, lists: tuple[tuple[str, ...], ...], n: int) -> Iterator[tuple[set[str], set[str]]]:
    """``n`` counterfactuals of texts with a neutral sentence put in: texts, lists and terms take turns."""
    for k in range(n):
        which = k % len(lists)
        terms, turn = lists[which], k // len(lists)
        a, b = terms[turn % len(terms)], terms[(turn + 1 + turn // len(terms)) % len(terms)]
        sentence = words_of(TEMPLATES[which % len(TEMPLATES)].format(""))
        held = sample.text(k % len(sample.docs)) | sentence
        one, two = features(held | {a}), features(held | {b})
        yield one - two, two - one


class Sample:
    """Training rows as numbers: a name is held once for each distinct word and feature, however many texts have it."""

    def __init__(self, rows: Iterable[tuple[Iterable[str], int]]):
        self.words: dict[str, int] = {}
        self.names: dict[str, int] = {}
        self.of_word: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        self.sets: list[np.ndarray] = []
        labels = []
        for words, label in rows:
            own = np.array([self.number(w) for w in words], np.int32)
            self.docs.append(own)
            self.sets.append(np.unique(np.array([f for w in own.tolist() for f in self.of_word[w]], np.int32)))
            labels.append(label)
        self.labels = np.array(labels, float)
        self.spelled = list(self.words)

    def number(self, word: str) -> int:
        n = self.words.setdefault(word, len(self.words))
        if n == len(self.of_word):
            self.of_word.append([self.names.setdefault(f, len(self.names)) for f in features_of(word)])
        return n

    def text(self, doc: int) -> set[str]:
        return {self.spelled[w] for w in self.docs[doc].tolist()}

    def mentioning(self, terms: set[str]) -> list[int]:
        known = np.array(sorted(self.words[t] for t in terms if t in self.words), np.int32)
        return [n for n, own in enumerate(self.docs) if len(known) and np.isin(own, known).any()]


def fit(
    rows: Iterable[tuple[Iterable[str], int]], identity: tuple[tuple[str, ...], ...] = IDENTITY, penalty: float = 4.0, ridge: float = 0.0005, rounds: int = 400, fill: int = TEMPLATED
) -> Model:
    """Weighted logistic regression of (words, label) with the counterfactual penalty, by full-batch gradient steps."""
    sample = Sample(rows)
    y = sample.labels
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Model({}, 8.0 if n1 else -8.0)
    df0, df1 = (np.bincount(np.concatenate([s for s, label in zip(sample.sets, y) if label == x]), minlength=len(sample.names)) for x in (0, 1))
    # Strength of association: log odds over its standard error.
    z = np.log((df1 + 0.5) / (n1 + 1) * (n0 + 1) / (df0 + 0.5)) / np.sqrt(1 / (df1 + 0.5) + 1 / (df0 + 0.5))
    strong = set(np.flatnonzero((df0 + df1 >= 3) & (np.abs(z) > 3)).tolist())
    order = sorted((-abs(z[n]), f) for f, n in sample.names.items() if n in strong)[:FEATURES]
    kept = sorted({f for _, f in order} | {f for terms in identity for t in terms for f in features_of(t)})
    at = {f: i for i, f in enumerate(kept)}
    column = np.full(len(sample.names) + 1, -1)
    for f, i in at.items():
        column[sample.names.get(f, len(sample.names))] = i
    column[-1] = -1

    def flat(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.empty(0, int), *own])

    def sparse(found: Iterable[set[str]]) -> list[np.ndarray]:
        return [np.array(sorted(at[f] for f in s if f in at), int) for s in found]

    columns = (column[s] for s in sample.sets)
    r, c = flat([np.sort(x[x >= 0]) for x in columns])
    # Of a pair only what differs changes the logit.
    one, two = [], []
    for doc in sample.mentioning({t for terms in identity for t in terms}):
        for a, b in swaps(sample.text(doc), identity):
            one += sparse([a])
            two += sparse([b])
    for a, b in templated(sample, identity, fill - len(one)):
        one += sparse([a])
        two += sparse([b])
    pairs, (r1, c1), (r2, c2) = len(one), flat(one), flat(two)
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0)) / len(y)
    w, b, m, v = np.zeros(len(kept)), 0.0, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, rounds + 1):
        logit = np.bincount(r, w[c], len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g_logit, g = weight * (p - y), 2 * ridge * w
        if pairs:
            change = np.bincount(r1, w[c1], pairs) - np.bincount(r2, w[c2], pairs)
            back = penalty * 2 * change / pairs
            g += np.bincount(c1, back[r1], len(kept)) - np.bincount(c2, back[r2], len(kept))
        g += np.bincount(c, g_logit[r], len(kept))
        full = np.append(g, g_logit.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, float(b), pairs)


def sampled(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Iterator[tuple[list[str], int]]:
    """Words and label of the training documents. Their ids, at most twice ``per_class``, are all that is broadcast to find the texts;
    a document comes back as its distinct words, those of all its rows together, a partition of documents at a time."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = smallest(rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"))), "toxic", per_class, "h", "doc_id")
    found = id_and_text(docs).join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "words": pa.array(words, pa.list_(pa.string()))})

    each = found.mapInArrow(run, f"doc_id {kind}, toxic int, words array<string>").select("doc_id", "toxic", F.explode_outer("words").alias("word")).distinct()
    got = stored(each.groupBy("doc_id", "toxic").agg(F.collect_list("word").alias("words")), "training")
    for r in got.orderBy("doc_id").toLocalIterator():
        yield r["words"], r["toxic"]


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, identity: tuple[tuple[str, ...], ...] = IDENTITY) -> Model:
    return fit(sampled(docs, labels, per_class), identity)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shipped.value)
        for batch in batches:
            got = [own.score(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(got, pa.float64())})

    return source.mapInArrow(run, f"doc_id {kind}, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    kept_out = F.coalesce(held_out(5, 0), F.lit(False))
    model = train(docs, labels.where(~kept_out))
    return score(docs, model).select("doc_id", kept_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
