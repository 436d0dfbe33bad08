"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are compared with those of
its language by Jensen-Shannon distance (base 2, from 0 to 1).

1. One pass counts, per language, character classes and words over all documents; counts of equal
   words combine before and after one shuffle. The most frequent words of a language are its
   common words; all others share one bin. Words count lower-cased (A-Z) and whole, with their
   punctuation; a common word has at most ``WORD_BYTES`` bytes.
2. One pass over the texts makes each document's counts, histograms and verdict. It needs the
   references only, which are bounded: ``languages`` times ``common`` words.

References: a language has one if it is among the ``languages`` with most words and has at least
``least_reference`` of them; documents of other languages, and those of none, are compared with
the histogram of all documents.

A short text strays from its language by chance. So its words are judged from ``least_words`` on
only, its characters from ``least_chars`` on, and the divergence that sampling alone explains is
allowed for: of k bins one of probability p adds about ``1 / (8 n ln 2)`` in a text of n words, at
most ``p / 2``, and the sum spreads by about ``sqrt(2 k)`` times as much as one bin. A document fails if the square of its distance of words exceeds ``limit_words`` squared
plus that allowance, or its distance of characters exceeds ``limit_chars``.

Null and empty texts have no words and fail the base rule. Repeated rows are answered one by one, a
null doc_id is kept, other columns are not read, and an empty table gives an empty result. A
document is the unit of memory.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written

SYMBOLS = b"#*$%&|<>"
WORD_BYTES = 64
DISTINCT = 200_000

#: Classes of characters: the first bytes of UTF-8 that belong to each, in the order of the bins.
CLASSES = {
    "lower": bytes(range(0x61, 0x7B)),
    "upper": bytes(range(0x41, 0x5B)),
    "digit": b"0123456789",
    "blank": b" \t\n\r\x0b\x0c",
    "stop": b".,;:!?",
    "quote": b"'\"()-",
    "latin": bytes(range(0xC0, 0xCA)),  # U+0080 to U+027F
    "other": bytes(range(0xCA, 0x100)),
}
NAMES = [*CLASSES, "rest"]  # all other ASCII


def _bins() -> np.ndarray:
    """The bin of each byte; bytes inside a character have one beyond the last."""
    bins = np.full(256, len(NAMES) - 1)
    bins[0x80:0xC0] = len(NAMES)
    for n, first in enumerate(CLASSES.values()):
        bins[list(first)] = n
    return bins


BINS = _bins()


def characters(text: bytes) -> np.ndarray:
    """Characters of the text per class."""
    found = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(BINS, found, len(NAMES) + 1)[: len(NAMES)].astype(np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence of two distributions, in bits: the square of the distance."""
    middle = (p + q) / 2
    total = 0.0
    for side in (p, q):
        held = side > 0
        total += float((side[held] * np.log2(side[held] / middle[held])).sum()) / 2
    return max(0.0, total)


def chance(p: np.ndarray, n: int) -> float:
    """The divergence from ``p`` that a sample of ``n`` has by chance, with one standard deviation."""
    one = 1 / (8 * n * np.log(2))
    return float(np.minimum(p / 2, one).sum() + one * np.sqrt(2 * len(p)))


@dataclass(frozen=True)
class Reference:
    """What is usual: common words with their bins, and the shares of words and characters."""

    words: dict[bytes, int]
    word_shares: np.ndarray
    char_shares: np.ndarray


@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    least_chars: int = 200
    limit_words: float = 0.3
    limit_chars: float = 0.3


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    _, pair = np.unique(number[:-2] * len(known) + number[1:-1], return_inverse=True)
    _, window, count = np.unique(pair * len(known) + number[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``kind`` (``char`` or ``word``), ``item`` and ``n`` over all documents. Words that
    are too long to be common count as the item null."""
    fields = [("lang", pa.string()), ("kind", pa.string()), ("item", pa.binary()), ("n", pa.int64())]
    schema = pa.schema(fields)

    def rows(words: dict, chars: dict) -> Iterator[pa.RecordBatch]:
        held = [(lang, "word", word, n) for lang, found in words.items() for word, n in found.items()]
        held += [(lang, "char", NAMES[i].encode(), int(n)) for lang, found in chars.items() for i, n in enumerate(found)]
        for at in range(0, len(held), 10_000):
            columns = zip(*held[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        words: dict = defaultdict(Counter)
        chars: dict = defaultdict(lambda: np.zeros(len(NAMES), np.int64))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or b""
                chars[lang] += characters(text)
                words[lang].update(w if len(w) <= WORD_BYTES else None for w in text.lower().split())
            if sum(map(len, words.values())) > DISTINCT:
                yield from rows(words, chars)
                words.clear()
                chars.clear()
        yield from rows(words, chars)

    counted = _plain(docs).mapInArrow(run, "lang string, kind string, item binary, n bigint")
    return counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string").cast("binary").alias("text")
    return small_batches(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), text)


def references(docs: DataFrame, common: int = 200, languages: int = 256, least_reference: int = 10_000) -> dict[str | None, Reference]:
    """The reference of each language, and under None that of all documents."""
    counts = written(_counts(docs), "counts")
    words = counts.where("kind = 'word'")
    sizes = words.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("size")).where(F.col("size") >= least_reference)
    sizes = sizes.orderBy(F.desc("size"), "lang").limit(languages)
    everything = counts.groupBy(F.lit(None).cast("string").alias("lang"), "kind", "item").agg(F.sum("n").alias("n"))
    held = counts.join(F.broadcast(sizes), "lang").select("lang", "kind", "item", "n").unionByName(everything)
    # At most `languages` + 1 rows of classes and totals, and `common` words each.
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    top = held.where("kind = 'word' AND item IS NOT NULL").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= common)
    found, totals, chars = defaultdict(list), {}, {}
    for r in top.select("lang", "item", "n", "rank").orderBy("lang", "rank").collect():
        found[r["lang"]].append((bytes(r["item"]), r["n"]))
    for r in held.where("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        totals[r["lang"]] = r["n"]
    for r in held.where("kind = 'char'").select("lang", "item", "n").collect():
        chars.setdefault(r["lang"], np.zeros(len(NAMES)))[NAMES.index(bytes(r["item"]).decode())] = r["n"]
    out = {}
    for lang, total in totals.items():
        counted = np.array([n for _, n in found[lang]] + [total - sum(n for _, n in found[lang])], float)
        out[lang] = Reference({w: i for i, (w, _) in enumerate(found[lang])}, counted / total, chars[lang] / chars[lang].sum())
    return out


FACTS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "word_distance double, char_distance double, base_failed boolean, kept boolean"
)


def judged(text: bytes, usual: Reference | None, rules: Rules) -> tuple:
    """All of ``FACTS`` but the doc_id. A distance is null where the text is too short to judge."""
    words = text.split()
    n, chars = len(words), characters(text)
    again = repeated_words(words)
    failed = n < 50 or 100 * again > 50 * n
    by_words = by_chars = None
    strays = False
    if usual and n >= rules.least_words:
        rest = len(usual.word_shares) - 1
        places = np.fromiter((usual.words.get(w, rest) for w in text.lower().split()), np.int64, n)
        apart = divergence(usual.word_shares, np.bincount(places, minlength=rest + 1) / n)
        strays |= apart > rules.limit_words**2 + chance(usual.word_shares, n)
        by_words = apart**0.5
    if usual and chars.sum() >= rules.least_chars:
        by_chars = divergence(usual.char_shares, chars / chars.sum()) ** 0.5
        strays |= by_chars > rules.limit_chars
    symbols = sum(text.count(s) for s in SYMBOLS)
    facts = n, int(chars.sum() - chars[NAMES.index("blank")]), symbols, repeated_lines(text), again
    return *facts, by_words, by_chars, failed, not failed and not strays


def judge(docs: DataFrame, usual: dict[str | None, Reference] | None = None, rules: Rules = Rules()) -> DataFrame:
    """``FACTS`` per document of ``docs`` (``doc_id``, ``lang``, ``text``), against given references
    or its own."""
    usual = references(docs) if usual is None else usual
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))]
        + [("word_distance", pa.float64()), ("char_distance", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    )

    def run(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text")
            found = [judged(t.as_py() or b"", usual.get(lang, usual.get(None)), rules) for lang, t in zip(langs, texts, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*found), list(schema)[1:]))]
            if found:
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return _plain(docs).withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, FACTS)
