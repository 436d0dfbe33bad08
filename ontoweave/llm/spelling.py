"""Spelling variants of a vocabulary by reduced-alphabet generation.

1. Tasks count the runs of letters of whole texts; counts of equal words combine before and
   after one shuffle. Words that are long and frequent enough are the vocabulary.
2. Letters are hashed to a few symbols, which turns a word into a reduced word. Two words that
   differ by one edit have reduced words that differ by one edit at most. The full one-edit
   neighbourhood of a reduced word over the few symbols is far smaller than that of the word
   over its letters, and a join of neighbourhoods with the reduced vocabulary misses nothing.
3. The join verifies on the original strings, inside its condition, so that words which agree
   by their symbols alone never leave it.
4. A word's form is its most frequent near word, if that is frequent enough; roots follow forms
   by doubling steps, as forms grow by a factor and chains are short.

Symbols are dealt to letters by their rank in the vocabulary, so that frequent letters stand
apart; their number grows with the vocabulary (its eighth root) and keeps groups of equal reduced
words small. Neighbourhoods travel as 64-bit hashes. A variant carries its word, if that has at
most ``CARRIED`` code points; longer ones, whose copies would take the square of their length,
travel by number and are verified by a join on it.

A null text has no words, a null doc_id counts as an empty one, rows that repeat a doc_id are
counted each, other columns are not read, and an empty table gives an empty vocabulary. Texts
are read in slices between words, so a long one costs no more memory than itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

# A-Z (lower-cased before), a-z and U+00C0 to U+00FF, as bytes of UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
GAP = re.compile(rb"[\x00-\x60\x7b-\x7f]")
SLICE = 1 << 20
DISTINCT = 200_000
CARRIED = 64
KEYS = 1 << 16


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes that end between two runs of letters."""
    at = 0
    while len(text) - at > SLICE:
        gap = GAP.search(text, at + SLICE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def typed(run: bytes, prefix: int, every: int) -> str:
    """The run without one code point, where the checksum of ``<doc_id>:<run>`` says so."""
    word, check = run.decode(), zlib.crc32(run, prefix)
    if every and check % every == 0:
        at = check % len(word)
        return word[:at] + word[at + 1 :]
    return word


def count_words(docs: DataFrame, every: int = 0) -> DataFrame:
    """``word`` and ``n``: occurrences of the lower-cased runs of letters in all texts.

    ``every`` plants slips of the pen: of runs whose crc32 with the doc_id it divides, one code
    point is left out.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(total: dict) -> Iterator[pa.RecordBatch]:
        made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], schema=schema)
        for at in range(0, made.num_rows, 10_000):
            yield made.slice(at, 10_000)

    def run(batches):
        total: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = (text.as_py() or b"").lower()
                found: Counter[bytes] = Counter()
                for part in slices(text):
                    found.update(RUN.findall(part))
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    total[typed(word, prefix, every)] += n
                if len(total) > DISTINCT:
                    yield from rows(total)
                    total.clear()
        yield from rows(total)

    plain = small_batches(docs).select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    counted = plain.mapInArrow(run, "word string, n bigint").where("word <> ''")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def alphabet(words: DataFrame, symbols: int | None) -> tuple[int, dict[str, int]]:
    """The number of symbols, and the symbol of each letter: its rank by frequency, modulo the
    number. The letters are collected; there are at most 95 of them in words of ``count_words``."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    ranked = [r["letter"] for r in letters.orderBy(F.desc("count"), "letter").collect()]
    if symbols is None:
        symbols, size = 4, words.count()
        while symbols**8 < size:
            symbols += 1
    return symbols, {letter: rank % symbols for rank, letter in enumerate(ranked)}


#: Fixed odd multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def reduced(words: list[str], table: dict[str, int]) -> np.ndarray:
    """Words of one length as a matrix of symbols, from 1."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    letters, at = np.unique(codes, return_inverse=True)
    return np.array([table[chr(c)] + 1 for c in letters], np.uint64)[at].reshape(len(words), -1)


def powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = (int(out[i - 1]) * BASE) & MASK
    return out


def _scanned(rows: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what precedes each place (the full word last), and of what starts there; the
    symbol at the end of a word has weight 1."""
    n, length = rows.shape
    weighed = rows * power[:length][::-1]
    after = np.zeros((n, length + 1), np.uint64)
    after[:, :-1] = np.cumsum(weighed[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    before = after[:, :1] - after  # weighed as if the rest of the word followed
    return before, after


def reduced_keys(rows: np.ndarray) -> np.ndarray:
    """One hash per reduced word."""
    return _scanned(rows, powers(rows.shape[1] + 2))[0][:, -1]


def neighbourhood(rows: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of words and hashes of their reduced words and all of one edit away, each once:
    of equal neighbours only the first is removed, and a symbol is put in only where it does
    not follow itself."""
    n, length = rows.shape
    power = powers(length + 2)
    base = np.uint64(BASE)
    weighed = [[np.uint64((s * int(p)) & MASK) for p in power] for s in range(symbols + 1)]
    before, after = _scanned(rows, power)
    places = np.arange(n)
    yield places, before[:, -1]
    # What precedes a place weighs one power less when a symbol behind it goes, one more when one comes.
    shrink = np.uint64(pow(BASE, -1, 1 << 64))
    for i in range(length + 1):
        if i < length:
            fresh = np.ones(n, bool) if i == 0 else rows[:, i] != rows[:, i - 1]
            yield places[fresh], (before[:, i] * shrink + after[:, i + 1])[fresh]
        for s in range(1, symbols + 1):
            symbol = np.uint64(s)
            if i < length:
                other = rows[:, i] != symbol
                yield places[other], (before[:, i] + weighed[s][length - 1 - i] + after[:, i + 1])[other]
            apart = np.ones(n, bool) if i == 0 else rows[:, i - 1] != symbol
            yield places[apart], (before[:, i] * base + weighed[s][length - i] + after[:, i])[apart]


def _by_length(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Places of the words of each length, as many as keep the matrices small."""
    sizes = np.fromiter(map(len, batch.column("word").to_pylist()), np.int64, batch.num_rows)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        step = max(1, KEYS // max(1, int(size)))
        for at in range(0, len(places), step):
            yield places[at : at + step]


def keyed(words: DataFrame, table: dict[str, int]) -> DataFrame:
    """``key`` (of the reduced word), ``id``, ``word`` and ``n``."""

    def run(batches):
        for batch in batches:
            names = batch.column("word").to_pylist()
            for places in _by_length(batch):
                key = reduced_keys(reduced([names[p] for p in places], table)).view(np.int64)
                part = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], names=["key", *batch.schema.names])

    return words.select("id", "word", "n").mapInArrow(run, "key bigint, id bigint, word string, n bigint")


def variants(words: DataFrame, table: dict[str, int], symbols: int, column: str) -> DataFrame:
    """``key`` and ``column`` (``word`` or ``id``) for all of each word's reduced neighbourhood."""
    kind = "string" if column == "word" else "bigint"

    def run(batches):
        for batch in batches:
            names = batch.column("word").to_pylist()
            for places in _by_length(batch):
                held = batch.column(column).take(pa.array(places))
                keys, owners, size = [], [], 0

                def rows():
                    at = pa.array(np.concatenate(owners))
                    key = pa.array(np.concatenate(keys).view(np.int64))
                    return pa.RecordBatch.from_arrays([key, held.take(at)], names=["key", column])

                for owner, key in neighbourhood(reduced([names[p] for p in places], table), symbols):
                    owners.append(owner)
                    keys.append(key)
                    size += len(key)
                    if size >= KEYS:
                        yield rows()
                        keys, owners, size = [], [], 0
                if size:
                    yield rows()

    return words.select(*dict.fromkeys([column, "word"])).mapInArrow(run, f"key bigint, {column} {kind}")


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``word``, ``other`` and ``other_n`` for all words of one edit between them, both ways.

    ``words``: distinct ``word`` (not empty) and ``n``.
    """
    vocabulary = written(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    symbols, table = alphabet(vocabulary, symbols)
    known = keyed(vocabulary, table).select("key", F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    # A word becomes a hundred variants, so a few files of words are dealt to many tasks.
    spread = vocabulary.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    long = F.char_length("word") > CARRIED
    one_edit = F.levenshtein("word", "other", 1) == 1
    short_pairs = variants(spread.where(~long), table, symbols, "word").alias("v").join(
        known.alias("k"), (F.col("v.key") == F.col("k.key")) & one_edit
    )
    numbered = variants(spread.where(long), table, symbols, "id").alias("v")
    long_pairs = numbered.join(known.alias("k"), (F.col("v.key") == F.col("k.key")) & (F.col("id") != F.col("other_id")))
    long_pairs = long_pairs.select("id", "other", "other_n").join(vocabulary.where(long).select("id", "word"), "id").where(one_edit)
    columns = ["word", "other", "other_n"]
    return short_pairs.select(*columns).unionByName(long_pairs.select(*columns))


def forms(words: DataFrame, near: DataFrame, factor: int = 5) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` per word.

    The form is the near word with the largest ``n``, of equals the first in code-point order,
    if that ``n`` is at least ``factor`` times the word's; the root ends the chain of forms.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    around = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.select("word", "n").join(around, "word", "left")
    enough = -F.col("best.less") >= F.col("n") * factor
    named = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    # A step doubles what it has walked: the root of a word becomes the root of its root.
    walked = named.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = walked.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(walked.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        walked = stepped.select("word", "root")
        if stepped.where("next IS NOT NULL").isEmpty():
            break
    rooted = named.join(walked, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(docs: DataFrame, every: int = 0, letters: int = 6, least: int = 5, factor: int = 5) -> DataFrame:
    """:func:`forms` of the words of all texts with at least ``letters`` code points and ``least``
    occurrences."""
    counted = count_words(docs, every).where((F.char_length("word") >= letters) & (F.col("n") >= least))
    words = written(counted, "words")
    return forms(words, near_words(words), factor)
