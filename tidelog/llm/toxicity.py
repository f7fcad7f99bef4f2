"""Toxicity scores from a lexicon, its misspellings and the context of each hit.

Lexicon: terms (words) and stems (beginnings of words) that labelled toxic texts hold far more often than others, learned from
the labelled rows given, with a short list of common insults in English, French, German and Spanish to start from. The terms stand in a trie. Each
distinct word that shares enough letters with some term is turned into a Levenshtein automaton, which runs over the trie: both are followed together, a
branch ends when the automaton has no state left, and every term within the allowed distance is found in one walk. Misspellings of all terms count; those
with another first letter have a weight of their own, and words that clean texts hold are none. Marks inside a word ('id!ot', 'st*pid') are read as letters or left out.

Context: of each hit, the WINDOW words on either side tell quotation and report (quotation marks, words of saying, negation)
from abuse (address to a person, more hits nearby). A logistic regression on a few sums over the hits of a text, fitted on a bounded
sample of labelled rows (SAMPLE, the rows of least hash), turns them into a score.

Defined cases: null and empty texts, and texts without any hit, get the score of a text with no hit; repeated rows get the
same score; null labels don't count as labelled; without any labelled row of either kind the list to start from and fixed
weights score; an empty table gives no rows; other columns stay out of the score. Texts are scored whole, whatever their length; labels that fall on one hash with the last of
the sample are all learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidelog.llm.common import claim, documents, fold, give_back, table

#: Labelled rows that a model is fitted on, at most, and terms in the lexicon, at most.
SAMPLE, TERMS = 20_000, 2_000
#: Longer words than this aren't misspellings.
LONGEST = 24
WINDOW = 6
COUNTED_AT_ONCE = 500
STEM = range(4, 8)
LEAST_TEXTS, LEAST_CLEAN, LEAST_EVIDENCE = 4, 2, 18.0
#: Insults to start from, and words that mark report, negation and address.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass bastard asshole bitch idiota estúpido imbécil basura connard salaud abruti crétin ordure idiotin dummkopf arschloch abschaum dreckskerl".split()
REPORTING = frozenset("said says say called calls quoted quote wrote writes word words term terms insult insults dit appelé mot sagte nannte wort dijo llamó palabra".split())
NEGATION = frozenset("not never no don't doesn't isn't pas jamais nicht kein nunca".split())
ADDRESS = frozenset("you you're your u ur tu vous toi du dich ihr usted eres te".split())
LETTERS = str.maketrans("0134578", "oieastb")  # digits written for letters
QUOTES = "\"'“”„«»‘’`"

#: Marks written for letters or put between them.
MARKS = str.maketrans("!|@$+", "iiast", "*#~_.-")
_SOFT = re.compile(r"[_.\-'’]*[^\W_]+(?:[_.\-'’]+[^\W_]+)*[_.\-'’]*")
_MARK = re.compile(r"[!|@$+*#~_.\-](?=[^\W_])|[^\W_][!|@$+](?=[!|@$+])")
_RUN = re.compile(r"[!|@$+*#~_.\-]*[^\W_]++(?:(?:['’]|[!|@$+*#~_.\-]++)[^\W_]++)*[!|@$+]*")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    """The text's words in lower case, each with the marks that touch it left out."""
    return _WORD.findall((text or "").lower())


def allowed(term: str) -> int:
    """Edits allowed in a term: none up to 4 letters, one up to 8, two beyond."""
    return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    lengths: int = 0  # bit n: a term of n letters ends below


class Trie:
    def __init__(self, terms: list[str]):
        self.root = Node()
        for t in terms:
            node = self.root
            for c in t:
                node = node.next.setdefault(c, Node())
                node.lengths |= 1 << len(t)
            node.term = t

    def within(self, word: str, edits: int) -> list[tuple[int, str]]:
        """(edits, term) of all terms within so many edits of the word. The automaton's states are bit sets of places in the word, one set for each number of edits so far; a trie letter moves them all at once."""
        m, at = len(word), {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        every, found, fit = (1 << m + 1) - 1, [], (1 << 2 * edits + 1) - 1 << m >> edits
        start = [(1 << e + 1) - 1 & every for e in range(edits + 1)]
        todo = [(self.root, start)]
        while todo:
            node, states = todo.pop()
            for c, child in node.next.items():
                if not child.lengths & fit:
                    continue
                mask, new, low = at.get(c, 0), [], 0
                for e, s in enumerate(states):
                    moved = (s & mask) << 1
                    if e:  # a letter more in the term, another letter, or letters more in the word
                        moved |= states[e - 1] | states[e - 1] << 1 | low << 1
                    low = moved & every
                    new.append(low)
                if any(new):
                    if child.term is not None:
                        for e, s in enumerate(new):
                            if s >> m & 1:
                                found.append((e, child.term))
                                break
                    todo.append((child, new))
        return sorted(found)


class Lexicon(dict):
    """self[word]: (kind, weight) of the best term; kind 0 is the term itself, 1 a misspelling, 2 a stem, 3 a misspelling with another first letter; None if there is none. Remembers the words that it has seen, up to a bound.
    fuzzy: the terms whose misspellings count; clean: words that are no misspellings, as clean texts hold them."""

    MOST = 150_000

    def __init__(self, terms: dict[str, float], stems: dict[str, float], fuzzy: list[str], clean: frozenset[str] = frozenset()):
        super().__init__()
        self.terms, self.stems, self.clean = terms, stems, clean
        self.lengths = sorted({len(s) for s in stems})
        self.tries = [(k, Trie(own), *self._parts(own, k)) for k in (1, 2) if (own := [t for t in fuzzy if allowed(t) == k])]

    @staticmethod
    def _parts(terms: list[str], edits: int) -> tuple[dict[str, set[int]], dict[str, set[int]], set[str], list[int]]:
        """Of a term with so many edits in it, one of edits + 1 parts is left as it was: the first at the start, the last at the end, one between anywhere. The first and last parts, with the lengths that a word may have; the inner ones; and their lengths."""
        first, last, inner = {}, {}, set()
        for t in terms:
            cuts = [round(i * len(t) / (edits + 1)) for i in range(edits + 2)]
            near = range(len(t) - edits, len(t) + edits + 1)
            first.setdefault(t[: cuts[1]], set()).update(near)
            last.setdefault(t[cuts[-2] :], set()).update(near)
            inner.update(t[a:b] for a, b in zip(cuts[1:-2], cuts[2:-1], strict=True))
        return first, last, inner, sorted({len(p) for p in (*first, *last, *inner)})

    def __missing__(self, word: str) -> tuple[int, float] | None:
        if len(self) >= self.MOST:
            self.clear()
        found = self[word] = self._marked(word) if _MARK.search(word) or word[-1:] in "!|@$+" else self._find(word)
        return found

    def _marked(self, run: str) -> tuple[int, float] | None:
        """The match of a word with marks in it: with outer marks left out or read as letters too. Points, dashes and lines also join words, so between letters they count only where the term itself comes out."""
        soft = _SOFT.fullmatch(run)
        for own in dict.fromkeys((run.strip("!|+*#~_.-"), run.lstrip("!|+*#~_.-"), run)):
            found = self._find(own.translate(MARKS).replace("'", "").replace("’", ""))
            if found and (found[0] == 0 or not soft):
                return found
        return None

    def _find(self, word: str) -> tuple[int, float] | None:
        if not word.isalpha() and not word.isdigit():
            word = word.translate(LETTERS)
        if word in self.terms:
            return 0, self.terms[word]
        for n in self.lengths:
            if (w := self.stems.get(word[:n])) is not None:
                return 2, w
        m, none = len(word), ()
        if not 3 < m <= LONGEST or word in self.clean:
            return None
        other = None
        for edits, trie, first, last, inner, sizes in self.tries:
            for n in sizes:
                if m in first.get(word[:n], none) or m in last.get(word[-n:], none) or (inner and any(word[i : i + n] in inner for i in range(1, m - n))):
                    for _, term in trie.within(word, edits):
                        if term[0] == word[0]:
                            return 1, self.terms[term]
                        other = other or (3, self.terms[term])  # words that merely end alike are among these
                    break
        return other


def joined(lower: str, lexicon: Lexicon) -> list[tuple[str, int]]:
    """The words of a text in lower case and their places; words with marks in them that match the lexicon as a whole, and no part of them alone, are one word."""
    out = []
    for m in _RUN.finditer(lower):
        run, at = m[0], m.start()
        if run.isalnum():
            out.append((run, at))
            continue
        parts = [(p[0], at + p.start()) for p in _WORD.finditer(run)]
        if parts[0][0] != run and not any(lexicon[p] for p, _ in parts) and lexicon[run]:
            parts = [(run, at)]
        out += parts
    return out


FEATURES = 10


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Sums over the hits of a text: 1, terms, misspellings, stems (each in log), the best weight, share of words, quoted or reported, addressed or clustered, different terms, and misspellings with another first letter (in log)."""
    out = np.zeros(FEATURES)
    out[0] = 1
    lower = (text or "").lower()
    placed = joined(lower, lexicon) if _MARK.search(lower) else None
    words = words_of(text) if placed is None else [w for w, _ in placed]
    matches = list(map(lexicon.__getitem__, words))
    if not any(matches):
        return out
    hits = [(i, m) for i, m in enumerate(matches) if m]
    counts, quoted, pointed, kinds = [0.0, 0.0, 0.0, 0.0], 0.0, 0.0, set()
    at = None if not any(q in text for q in QUOTES) else [m.start() for m in _WORD.finditer(lower)] if placed is None else [i for _, i in placed]
    places = [i for i, _ in hits]
    for n, (i, (kind, _)) in enumerate(hits):
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        cited = any(w in REPORTING or w in NEGATION for w in near)
        if at:
            before, after = lower[max(0, at[i] - 1) : at[i]], lower[at[i] + len(words[i]) : at[i] + len(words[i]) + 2]
            cited = cited or (before != "" and before in QUOTES and any(q in after for q in QUOTES))
        close = (n > 0 and i - places[n - 1] <= WINDOW) or (n + 1 < len(places) and places[n + 1] - i <= WINDOW)
        counts[kind] += 0.5 if cited else 1.0
        quoted += cited
        pointed += close or any(w in ADDRESS for w in near)
        kinds.add(words[i])
    total = len(hits)
    out[1:] = [*(math.log1p(c) for c in counts[:3]), max(w for _, (_, w) in hits), math.sqrt(total / len(words)), quoted / total, pointed / total, math.log1p(len(kinds)), math.log1p(counts[3])]
    return out


#: Weights where nothing is labelled.
UNFITTED = np.array([-4.0, 3.0, 3.5, 1.0, 0.3, 1.0, -1.0, 0.5, 1.0, 2.0])


@dataclass
class Model:
    terms: dict[str, float]
    stems: dict[str, float]
    fuzzy: list[str]
    weights: np.ndarray
    clean: frozenset[str] = frozenset()

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.stems, self.fuzzy, self.clean)

    def scores(self, texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
        return self.score(np.array([features(t.as_py(), lexicon) for t in texts]).reshape(-1, FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps. A ridge draws all weights but the first to UNFITTED, so a kind of hit that the sample hardly shows keeps the weight it has without one."""
    w, keep = UNFITTED.copy(), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + (w - UNFITTED) @ keep @ (w - UNFITTED) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ (w - UNFITTED))
        now = cost(w)
        while np.abs(step).max() > 1e-9 and cost(w + step) > now:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _evidence(pos: int, neg: int, all_pos: int, all_neg: int) -> float:
    """The log-likelihood ratio (G squared) that a feature's share differs between toxic and other texts."""
    n, have = all_pos + all_neg, pos + neg
    cells = ((pos, all_pos, have), (neg, all_neg, have), (all_pos - pos, all_pos, n - have), (all_neg - neg, all_neg, n - have))
    return 2 * sum(k * math.log(k * n / (row * column)) for k, row, column in cells if k)


def _marked(batches):
    """Two least hashes of each text's three-word runs, which near copies mostly share."""
    claim("toxicity")
    for batch in batches:
        keys: list[list[int]] = [[], []]
        for text in batch.column(0).to_pylist():
            words = text.lower().split()
            runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
            for seed, own in enumerate(keys):
                own.append(min(xxhash.xxh3_64_intdigest(r, seed) for r in runs) - (1 << 63))
        yield pa.record_batch([*batch.columns, pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64())], names=["text", "toxic", "a", "b"])


def _counted(batches):
    """Texts of each kind that hold a word or a beginning of a word, for some texts at a time."""
    claim("toxicity")
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED_AT_ONCE):
            part = batch.slice(at, COUNTED_AT_ONCE)
            counts = (Counter(), Counter())
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = set(words_of(text))
                counts[toxic].update(own)
                counts[toxic].update({f"{w[:n]}*" for w in own for n in STEM if len(w) > n})
            keys = [*counts[0].keys() | counts[1].keys()]
            yield pa.record_batch({"key": pa.array(keys, pa.string()), "pos": pa.array([counts[1][k] for k in keys], pa.int64()), "neg": pa.array([counts[0][k] for k in keys], pa.int64())})
    give_back()


def _matching(*lexicon_of):
    """Of words, those that would count as misspellings."""

    def run(batches):
        lexicon = Lexicon(*lexicon_of)
        for batch in batches:
            yield pa.record_batch({"key": pa.array([w for w in batch.column(0).to_pylist() if (found := lexicon[w]) and found[0] in (1, 3)], pa.string())})

    return run


def _featured(*lexicon_of):
    def run(batches):
        lexicon = Lexicon(*lexicon_of)
        for batch in batches:
            x = [features(t.as_py(), lexicon).tolist() for t in batch.column(0)]
            yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "toxic": batch.column(1)})

    return run


def fit(labelled: DataFrame) -> Model:
    """labelled: text, toxic. Learns from SAMPLE rows at most; of near copies with one label mostly one counts, since the words that only they share say nothing."""
    rows = labelled.filter("toxic in (0, 1)").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic")).dropDuplicates()
    tasks = labelled.sparkSession.sparkContext.defaultParallelism
    found = table(rows.withColumn("hash", F.xxhash64("text")), "found")
    last = found.select("hash").orderBy("hash").limit(SAMPLE).agg(F.max("hash")).first()[0]  # hashes only, no texts, meet in one task
    drawn = found.filter(F.col("hash") <= F.lit(last)).select("text", "toxic").repartition(tasks).mapInArrow(_marked, "text string, toxic int, a long, b long")
    one_a = drawn.groupBy("a", "toxic").agg(F.min(F.struct("text", "b")).alias("kept")).select("toxic", "kept.text", "kept.b")
    sample = table(one_a.groupBy("b", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "labelled")
    of = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    all_pos, all_neg = of.get(1, 0), of.get(0, 0)
    terms, stems = {t: 2.0 for t in INSULTS}, {}
    if not all_pos or not all_neg:
        return Model(terms, stems, INSULTS, UNFITTED)
    counts = table(sample.repartition(tasks).mapInArrow(_counted, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "counts")
    likely = counts.filter((F.col("pos") >= LEAST_TEXTS) & (F.col("pos") * all_neg > 4 * F.col("neg") * all_pos)).orderBy(F.desc("pos"), "neg", "key").limit(10 * TERMS).collect()
    found = sorted(((_evidence(r["pos"], r["neg"], all_pos, all_neg), r["key"], math.log((r["pos"] + 0.5) / (all_pos + 1)) - math.log((r["neg"] + 0.5) / (all_neg + 1))) for r in likely), reverse=True)
    for g, key, weight in [f for f in found if f[0] >= LEAST_EVIDENCE][:TERMS]:
        if key[-1] == "*":  # of a stem and its beginnings, the one of most evidence
            if not any(s.startswith(key[:-1]) or key.startswith(s) for s in stems):
                stems[key[:-1]] = weight
        else:
            terms[key] = weight
    # a stem that stands only in words that are terms themselves adds nothing but accidents
    pos = {r["key"]: r["pos"] for r in likely}
    stems = {s: w for s, w in stems.items() if pos[f"{s}*"] > 1.3 * max((pos.get(t, 0) for t in terms if t.startswith(s)), default=0)}
    lengths = sorted({len(s) for s in stems})
    terms = {t: w for t, w in terms.items() if t in INSULTS or not any(t[:n] in stems for n in lengths)}
    fuzzy = [t for t in terms if allowed(t)]
    # words of several clean texts, and no more common in toxic ones, are words of their own
    known = counts.filter((F.col("neg") >= LEAST_CLEAN) & (F.col("pos") * all_neg <= F.col("neg") * all_pos) & ~F.col("key").endswith("*")).select("key")
    clean = frozenset(r["key"] for r in known.mapInArrow(_matching(terms, stems, fuzzy), "key string").collect())  # near words of terms, from SAMPLE rows
    got = sample.repartition(tasks).mapInArrow(_featured(terms, stems, fuzzy, clean), "x array<double>, toxic int").collect()  # SAMPLE rows of FEATURES numbers at most
    return Model(terms, stems, fuzzy, fit_weights(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)), clean)


def _scored(model: Model):
    def run(batches):
        lexicon = model.lexicon()
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(model.scores(batch.column(1), lexicon), pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row of docs."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_scored(model), "doc_id long, score double")


def scorer(model: Model):
    """A function of a text column that gives scores; only the text passes to Python and only the scores back."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        claim("toxicity")
        lexicon = model.lexicon()
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t, lexicon) for t in texts]).reshape(-1, FEATURES)))
        lexicon.clear()
        give_back()

    return F.pandas_udf(run, DoubleType())


def reject(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score stays below the threshold."""
    return docs.filter(scorer(model)(F.coalesce(F.col(text).cast("string"), F.lit(""))) < threshold)


def labelled_documents(docs: DataFrame, labels: DataFrame, learn_from=None) -> DataFrame:
    """text, toxic of the documents of SAMPLE labels, those of least hash among the ones that learn_from (a condition on doc_id) lets through. The labels are few enough to broadcast, so no text is shuffled to find them."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic is not null and doc_id is not null")
    if learn_from is not None:
        own = own.filter(learn_from)
    drawn = own.dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    """Learned from the labels of folds 0 and 2 of 3."""
    return fit(labelled_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of fold 1 of 3 are not seen."""
    scored = score(documents(spark, sf_dir), model_for(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
