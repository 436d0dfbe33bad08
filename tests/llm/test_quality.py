import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ontoweave.llm import quality

DOCS = "doc_id bigint, lang string, text string"
WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)), failed


def classes(text):
    rules = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:!?]", "['\"()-]", "[\x80-ɿ]", "[ʀ-\U0010ffff]"]
    counts = [len(re.findall(rule, text)) for rule in rules]
    return counts + [len(text) - sum(counts)]


def apart(p, q):
    """Jensen-Shannon divergence by its definition through entropies."""
    entropy = lambda d: -sum(x * math.log2(x) for x in d if x > 0)
    return entropy([(x + y) / 2 for x, y in zip(p, q)]) - (entropy(p) + entropy(q)) / 2


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, common=200, least=10_000):
    def reference(texts):
        words = Counter(w for t in texts for w in re.findall(WORD, lower(t)))
        top = sorted((w for w in words if len(w.encode()) <= 64), key=lambda w: (-words[w], w.encode()))[:common]
        total = sum(words.values())
        shares = [words[w] / total for w in top]
        chars = np.sum([classes(t) for t in texts], axis=0)
        return top, [*shares, 1 - sum(shares)], chars / chars.sum(), total

    texts = [(lang, text or "") for _, lang, text in rows]
    everything = reference([t for _, t in texts])
    own = {lang: reference([t for x, t in texts if x == lang]) for lang in {x for x, _ in texts if x}}
    out = []
    for doc_id, lang, text in rows:
        facts, failed = base(text)
        text, n = text or "", facts[0]
        top, shares, chars, _ = own[lang] if lang in own and own[lang][3] >= least else everything
        strays = False
        if n >= 50:
            words = Counter(re.findall(WORD, lower(text)))
            mine = [words[w] / n for w in top]
            one = 1 / (8 * n * math.log(2))
            chance = sum(min(p / 2, one) for p in shares) + one * math.sqrt(2 * len(shares))
            strays = apart(shares, [*mine, 1 - sum(mine)]) > 0.09 + chance
        if len(text) >= 200:
            strays = strays or math.sqrt(max(0, apart(chars, np.array(classes(text)) / len(text)))) > 0.3
        out.append((doc_id, *facts, failed, not failed and not strays))
    return out


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    made = []
    for lang, letters in (("en", "aeiotnsr"), ("xx", "uédñ"), ("zz", "qwk")):
        vocabulary = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) for _ in range(500)]
        weights = [1 / (i + 1) for i in range(500)]
        for i in range({"en": 60, "xx": 60, "zz": 3}[lang]):
            words = draw.choices(vocabulary, weights, k=draw.choice([30, 60, 150, 500, 900]))
            made.append((len(made), lang, " ".join(w.capitalize() if draw.random() < 0.1 else w for w in words) + ".\nEnd of it"))
    shouted = made[3][2].upper()
    symbols = " ".join(w + "***" for w in made[4][2].split())
    again = "The same old line.\n" * 40
    made += [(900, "en", shouted), (901, "en", symbols), (902, "en", again), (903, None, made[5][2]), (904, "xx", made[6][2])]
    made += [(905, "en", None), (906, "en", ""), (907, None, " \t\n"), (None, "en", made[7][2]), (7, "en", made[7][2])]
    return made + [(908, "en", "x" * 300 + " 漢字 \x85  " + "y " * 3), (909, "q" * 99, made[8][2] + "\n" * 5 + made[8][2])]


def test_by_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "0 AS n_words", "'x' AS kept", "1 AS item")
    got = quality.judge(frame.repartition(5)).drop("word_distance", "char_distance").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows), key=repr)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[900] and not kept[901] and not kept[902]
    usual = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and r["n_words"] >= 60]
    assert sum(r["kept"] for r in usual) >= 0.95 * len(usual)


def test_repeated_words_and_lines():
    assert quality.repeated_words([]) == quality.repeated_words([b"a"] * 3) == 0
    assert quality.repeated_words([b"a"] * 4) == 4
    assert quality.repeated_words(b"a b c d a b c".split()) == 6
    assert quality.repeated_lines(b"a\n\n \na\nb\na") == 2


def test_divergence():
    p, q = np.array([0.5, 0.5, 0]), np.array([0, 0, 1.0])
    assert quality.divergence(p, p) == 0 and quality.divergence(p, q) == pytest.approx(1)
    assert quality.divergence(np.array([0.9, 0.1]), np.array([0.4, 0.6])) == pytest.approx(apart([0.9, 0.1], [0.4, 0.6]))


def test_references_are_bounded(spark, rows):
    frame = spark.createDataFrame(rows, DOCS)
    found = quality.references(frame, common=10, languages=1, least_reference=100)
    assert len(found) == 2 and None in found and all(len(r.words) == 10 for r in found.values())


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], DOCS)).collect() == []
