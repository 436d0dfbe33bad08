import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ontoweave.llm import spelling

DOCS = "doc_id bigint, text string"


def counted(rows, every=0):
    total = Counter()
    for doc_id, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            check = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and check % every == 0:
                at = check % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if w}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words, factor=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= factor * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    stems = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = draw.choice(stems)
            if draw.random() < 0.1:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "a", "é", w[at] + "c"]) + w[at + 1 :]
            words.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((i, draw.choice([" ", ", ", "1", "Ā", "\n"]).join(words)))
    return rows + [(None, "xyzxyz Xyzxyz"), (3, rows[3][1]), (400, None), (401, ""), (402, "×÷ ÀÉ 123")]


def run(spark, rows, **how):
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' AS word", "1 AS n", "2 AS key", "'x' AS form")
    return sorted(map(tuple, spelling.variant_groups(frame.repartition(3), **how).collect()))


@pytest.mark.parametrize("every", [0, 7])
def test_by_brute_force(spark, texts, every):
    words = {w: n for w, n in counted(texts, every).items() if len(w) >= 6 and n >= 5}
    assert len(words) > 50
    assert run(spark, texts, every=every) == brute(words)


def test_chains_of_forms_and_ties(spark):
    often = {"aaaaaab": 1, "aaaaaa": 6, "aaaaac": 40, "aaaadc": 300, "zzzzzz": 30, "zzzzzy": 6, "zzzzzx": 30}
    rows = [(1, " ".join([w] * n)) for w, n in often.items()]
    got = run(spark, rows, least=1)
    assert got == brute(often)
    roots = {r[0]: r[2] for r in got}
    assert roots["aaaaaab"] == "aaaadc" and roots["zzzzzy"] == "zzzzzx"


def test_symbols_do_not_change_the_result(spark, texts):
    words = {w: n for w, n in counted(texts).items() if n >= 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint")
    wanted = sorted((w, v, words[v]) for w in words for v in words if one_edit(w, v))
    for symbols in (1, 2, 5, 40):
        assert sorted(map(tuple, spelling.near_words(frame, symbols).collect())) == wanted


def test_long_words_are_verified_by_number(spark, monkeypatch):
    draw = random.Random(1)
    long = "".join(draw.choice("abc") for _ in range(3000))
    words = {long: 100, long[:7] + long[8:]: 9, long + "c": 5, "b" + long[1:] if long[0] != "b" else "a" + long[1:]: 8, "aaaaaa": 7, "aaaaaab": 6}
    rows = [(1, " ".join(f"{w}!" for w, n in words.items() for _ in range(n)))]
    monkeypatch.setattr(spelling, "SLICE", 5000)
    got = run(spark, rows)
    assert got == brute(words)


def test_slices_end_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    for text in (b"", b"aaaaaaaaaaaaaaaaaaaaaaaa", "ééé aaaaaa bbbbbb,cc Āaaaaaaaaa 1".encode(), b"       a     "):
        parts = list(spelling.slices(text))
        assert b"".join(parts) == text
        assert [w for p in parts for w in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


@pytest.mark.parametrize("length", [1, 2, 6])
def test_neighbourhoods_are_full_and_hold_each_word_once(length):
    symbols, draw = 3, random.Random(length)
    words = [tuple(draw.randint(1, symbols) for _ in range(length)) for _ in range(20)]
    key = lambda w: int(spelling.reduced_keys(np.array([w], np.uint64).reshape(1, -1))[0])
    got = [[] for _ in words]
    for places, keys in spelling.neighbourhood(np.array(words, np.uint64), symbols):
        for place, k in zip(places, keys.tolist()):
            got[place].append(k)
    for word, found in zip(words, got):
        around = {word, *(word[:i] + word[i + 1 :] for i in range(length))}
        around |= {word[:i] + (s,) + word[i + 1 :] for i in range(length) for s in range(1, symbols + 1)}
        around |= {word[:i] + (s,) + word[i:] for i in range(length + 1) for s in range(1, symbols + 1)}
        assert sorted(found) == sorted(key(w) if w else 0 for w in around)


def test_nothing_to_group(spark):
    assert run(spark, [(1, None), (2, "short one")]) == []
    assert spelling.variant_groups(spark.createDataFrame([], DOCS)).collect() == []
