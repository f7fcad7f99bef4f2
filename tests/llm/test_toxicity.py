import itertools
import random

import numpy as np
import pytest

from tests.llm.common import TEXTS, awkward
from tidelog.llm import toxicity as t

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_the_distance():
    rng = random.Random(1)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    trie = t.Trie(terms)
    for _ in range(400):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
        for edits in (0, 1, 2):
            assert trie.within(word, edits) == sorted({(distance(word, x), x) for x in terms if distance(word, x) <= edits})


def test_filter_loses_no_misspelling():
    lexicon = t.Lexicon({w: 1.0 for w in t.INSULTS}, {}, t.INSULTS)
    rng = random.Random(2)
    for term in t.INSULTS:
        for _ in range(60):
            word = list(term)
            for _ in range(t.allowed(term)):
                at = rng.randrange(1, len(word))
                word[at : at + 1] = rng.choice([[], [rng.choice("xyz0")], [word[at], rng.choice("xyz0")]])
            word = "".join(word)
            if 3 < len(word):
                assert lexicon[word] is not None, (term, word)
    assert lexicon["window"] is None and lexicon["idi0t"] == lexicon["1d1ot"] == (0, 1.0) and lexicon["idito"] is None and lexicon["idiott"] == (1, 1.0) and lexicon["idiot"] == (0, 1.0)


def test_first_letters_and_marks_are_not_lost():
    lexicon = t.Lexicon({w: 1.0 for w in t.INSULTS}, {}, t.INSULTS, frozenset(["poser"]))
    rng = random.Random(4)
    for term in t.INSULTS:
        for _ in range(60):
            word = list(term)
            for _ in range(t.allowed(term)):
                at = rng.randrange(len(word))
                word[at : at + 1] = rng.choice([[], [rng.choice("xyz0")], [word[at], rng.choice("xyz0")]])
            if 3 < len(word):
                assert lexicon["".join(word)] is not None, (term, word)
    assert lexicon["xidiot"] == lexicon["ztupid"] == lexicon["diot"] == (3, 1.0) and lexicon["poser"] is None
    for text in ("you id!ot", "you st*pid man", "@sshole!", "an i.d.i.o.t here", "$tupid", "such a dumba$$", "s-t-u-p-i-d", "!diot"):
        assert t.features(text, lexicon)[1:4].sum() + t.features(text, lexicon)[9] > 0, text
    for text in ("a well-known fact. next", "mail some.one@host.example now", "you! are + fine", "snake_case stu-pit", "wait...what", "!!! @@ $5 -"):
        assert not t.features(text, lexicon)[1:].any(), text
    cited = t.features('the word "id!ot" here', lexicon)
    assert cited[6] == 1 and t.words_of("id!ot") == ["id", "ot"]


def test_misspellings_of_all_learned_terms_count(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = [(" ".join(word() for _ in range(30)) + (" vermin" if i % 4 == 0 else " german" if i % 4 == 1 else "") + (" parasite" if i % 8 == 0 or i == 1 else ""), int(i % 4 == 0)) for i in range(400)]
    model = t.fit(spark.createDataFrame(rows, "text string, toxic int"))
    lexicon = model.lexicon()
    assert {"vermin", "parasite"} <= set(model.terms) and lexicon["vermiin"][0] == lexicon["parasote"][0] == 1 and lexicon["german"] is None


def test_quotation_counts_less():
    lexicon = t.Lexicon({"idiot": 3.0}, {}, ["idiot"])
    abuse, cited, clean = (t.features(x, lexicon) for x in ("you are an idiot", 'the word "idiot" was quoted', "you are fine"))
    assert abuse[1] > cited[1] > 0 == clean[1] and cited[6] == 1 and abuse[7] == 1
    for text in (None, "", " ", "?!"):
        assert (t.features(text, lexicon) == [1, *[0] * (t.FEATURES - 1)]).all()


def test_weights_find_the_boundary():
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(500), rng.normal(size=(500, t.FEATURES - 1))]
    y = (x[:, 1] + 0.1 * rng.normal(size=500) > 0).astype(float)
    w = t.fit_weights(x, y)
    assert ((x @ w > 0) == y).mean() > 0.95 and t.fit_weights(x, np.zeros(500))[0] < -3


def test_awkward_rows_and_no_labels(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(0, 0), (5, None), (None, 1), (6, 1), (99, 1)], "doc_id bigint, toxic int")
    for own in (labels, labels.filter("toxic = 7")):
        model = t.fit(t.labelled_documents(df, own))
        rows = t.score(df, model).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
        assert t.reject(df, model, 1.1).collect().__len__() == len(TEXTS) and t.reject(df, model, 1.1).columns == df.columns
    assert t.score(awkward(spark, []), model).count() == 0 and t.reject(awkward(spark, []), model).count() == 0
    unlearned = t.Model({"idiot": 2.0}, {}, ["idiot"], t.UNFITTED)
    texts = spark.createDataFrame([(1, "you idiot, you idiot"), (2, "you fine person")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in t.reject(texts, unlearned, 0.5).collect()] == [2]


def test_near_copies_count_once(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    rows = [(" ".join(word() for _ in range(30)) + (" vermin vermin" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(160)]
    shared = " ".join(word() for _ in range(40))
    rows += [(f"{shared} extra{i}", 1) for i in range(30)]
    model = t.fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert "vermin" in model.terms and not set(shared.split()) & set(model.terms)


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables")
def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = t.op2_toxicity(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    of = {y: [r["score"] for r in rows if r["toxic"] == y] for y in (0, 1)}
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(of[1], of[0])])
    assert auc > 0.85 and sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.02 * len(of[0])


def plain_features(text, terms):
    """Matches by distances to every term, and the sums over them, word by word; for texts without marks inside words."""
    words, places = [], []
    lower, at = text.lower(), 0
    for token in lower.split(" "):
        core = token.strip("\"")
        if core:
            words.append(core)
            places.append(at + token.index(core))
        at += len(token) + 1
    hits = {}
    for i, w in enumerate(words):
        if w in terms:
            hits[i] = (0, terms[w])
            continue
        near = sorted((t.allowed(x), distance(w, x), x) for x in terms if t.allowed(x) and len(w) > 3 and distance(w, x) <= t.allowed(x))
        same = [x for _, _, x in near if x[0] == w[0]]
        if near:
            hits[i] = (1, terms[same[0]]) if same else (3, terms[near[0][2]])
    out = np.zeros(t.FEATURES)
    out[0] = 1
    if not hits:
        return out
    counts, quoted, pointed = [0.0] * 4, 0, 0
    for i, (kind, _) in hits.items():
        near = range(max(0, i - t.WINDOW), min(len(words), i + t.WINDOW + 1))
        cited = any(words[k] in t.REPORTING or words[k] in t.NEGATION for k in near)
        end = places[i] + len(words[i])
        cited |= places[i] > 0 and lower[places[i] - 1] == '"' and '"' in lower[end : end + 2]
        counts[kind] += 0.5 if cited else 1
        quoted += cited
        pointed += any(words[k] in t.ADDRESS for k in near) or any(k in hits for k in near if k != i)
    out[1:] = [np.log1p(counts[0]), np.log1p(counts[1]), 0, max(w for _, w in hits.values()), np.sqrt(len(hits) / len(words)), quoted / len(hits), pointed / len(hits), np.log1p(len({words[i] for i in hits})), np.log1p(counts[3])]
    return out


def test_features_against_plain_ones():
    rng = random.Random(6)
    terms = {w: 1.0 + k / 10 for k, w in enumerate(["idiot", "scum", "pathetic", "imbecile", "worthless"])}
    lexicon = t.Lexicon(terms, {}, list(terms))
    other = "you said not the house river stone walks green mountain quickly they never wrote a word about pathways worth idle".split()
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(0, 40)):
            w = rng.choice(other) if rng.random() < 0.8 else rng.choice(list(terms))
            if w in terms and rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", w[at] + "z"]) + w[at + 1 :]
            words.append(f'"{w}"' if rng.random() < 0.1 else w)
        text = " ".join(words)
        assert np.allclose(t.features(text, lexicon), plain_features(text, terms)), text


def test_texts_of_megabytes_are_scored_whole():
    lexicon = t.Lexicon({"idiot": 3.0}, {}, ["idiot"])
    text = "a fine house by the river " * 100_000
    assert not t.features(text, lexicon)[1:].any() and t.features(text + "you idiot", lexicon)[1] > 0
