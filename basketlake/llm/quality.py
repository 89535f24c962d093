"""Quality classifier: supervised subword embeddings.

A text is the average of hashed vectors of its words, their character n-grams, adjacent word pairs
and words that come again within a few places; a softmax over two classes reads the average. Vectors
and softmax are trained together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows. The two classes differ by a linear function of the average, so for scoring a vector
is a single number, and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlake.llm.chunks import joined, word_hashes
from basketlake.llm.common import texts

MEMO, MEMO_BYTES, BLOCK = 300_000, 32_000_000, 200_000


@dataclass(frozen=True)
class Training:
    """Bounds and steps of the fit; ``per_class`` labelled rows of each class are its whole input."""
    per_class: int = 2500
    buckets: int = 1 << 17
    dimensions: int = 8
    epochs: int = 6
    rate: float = 4.0
    grams: tuple[int, int] = (2, 4)
    reach: int = 4
    seed: int = 17


class Features:
    """Hashed features of words, remembered for distinct words."""

    def __init__(self, settings: Training):
        self.settings, self.mask, self.words = settings, settings.buckets - 1, {}

    def of_word(self, word: bytes) -> np.ndarray:
        """The word itself and its character n-grams with marks at both ends."""
        import zlib

        crc, mask = zlib.crc32, self.mask
        found = [crc(word, 1) & mask]
        low, high = self.settings.grams
        if word.isascii():  # characters are bytes
            marked = b"<" + word + b">"
            for n in range(low, high + 1):
                found += [crc(marked[i:i + n], n) & mask for i in range(len(marked) - n + 1)]
        else:
            letters = "<" + word.decode("utf-8", "replace") + ">"
            for n in range(low, high + 1):
                found += [crc(letters[i:i + n].encode("utf-8", "replace"), n) & mask
                          for i in range(len(letters) - n + 1)]
        return np.array(found, np.int32)

    def learn(self, words: list[bytes]) -> None:
        if len(self.words) > MEMO:
            self.words = {}
        for word in set(words):
            if word not in self.words:
                self.words[word] = self.of_word(word)

    def between(self, hashes: np.ndarray) -> np.ndarray:
        """Adjacent pairs, and one feature a distance for a word that comes again."""
        pairs = (joined(hashes[:-1], hashes[1:]) & np.uint64(self.mask)).astype(np.int32)
        again = [np.full(int((hashes[:-d] == hashes[d:]).sum()), d, np.int32)
                 for d in range(1, self.settings.reach + 1) if len(hashes) > d]
        return np.concatenate([pairs, *again])

    def of_text(self, text: bytes) -> np.ndarray:
        words, hashes = word_hashes(text)
        self.learn(words)
        return np.concatenate([*map(self.words.__getitem__, words), self.between(hashes)]) if words else \
            np.array([], np.int32)


def example(features: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct features of a text, each one's share of the average, and the class."""
    at, n = np.unique(features, return_counts=True)
    return at, (n / max(1, len(features))).astype(np.float32), label


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Training) -> tuple[np.ndarray, float]:
    """(value by bucket, bias): the log odds of class 1 are the mean value of a text's features, plus bias.

    One step a text: softmax, then the gradient to the output and to the vectors of its features,
    each by its share of the average. The rate falls linearly to zero.
    """
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.dimensions)) / settings.dimensions
    output, bias = np.zeros((2, settings.dimensions)), np.zeros(2)
    packed = [example for example in examples if len(example[0])]
    steps, done = max(1, len(packed) * settings.epochs), 0
    for _ in range(settings.epochs):
        for i in rng.permutation(len(packed)):
            at, share, label = packed[i]
            rate = settings.rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            logits = output @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = error @ output
            output -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            vectors[at] -= rate * np.outer(share / max(share.max(), 1e-9) * 0.1, back)
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, learnable: Column, settings: Training = Training()):
    """The fitted (values, bias), or a constant where a class has no rows.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. Of each class the rows of the least
    id hashes are taken, at most ``per_class``; the log odds are then shifted to the shares of the
    classes among all learnable ids, which are counted in full. An id that several rows of ``labels``
    name counts once, with its least label; of several documents of one id the one of the least text
    hash is learnt from. A null text is empty. The fit is one task over the bounded sample; the result
    has one number a bucket.
    """
    usable = labels.where(learnable & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id", F.lit(settings.seed))
    sample = None
    for label in (0, 1):
        part = usable.where(F.col("quality") == label).orderBy(order, "doc_id").limit(settings.per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 x per_class rows: the broadcast has a fixed bound
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "quality", order.alias("turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, examples = Features(settings), []
        for batch in batches:
            for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                examples.append(example(features.of_text(text), label))
        values, bias = fit(examples, settings)
        counts = np.bincount([label for *_, label in examples], minlength=2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([values.tobytes()], pa.binary()), pa.array([bias]),
             pa.array([int(counts[0])], pa.int64()), pa.array([int(counts[1])], pa.int64())],
            names=["values", "bias", "n0", "n1"])

    if not totals.get(0) or not totals.get(1):
        values, shift = np.zeros(settings.buckets, np.float32), 20.0 if totals.get(1) or not totals else -20.0
        return values, shift
    found = rows.repartition(1).sortWithinPartitions("turn", "quality", "text").mapInArrow(
        run, "values binary, bias double, n0 bigint, n1 bigint").first()
    shift = 0.0
    if found["n0"] and found["n1"]:
        shift = float(np.log(totals[1] / totals[0]) - np.log(found["n1"] / found["n0"]))
    return np.frombuffer(found["values"], np.float32), found["bias"] + shift


def crc_steps() -> np.ndarray:
    """CRC-32 of every byte, from its polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


class WordValues(dict):
    """A number for every word met, with the word's hash, the sum of its features' values and their count.

    Looking a word up numbers it; ``settle`` then works out all new words side by side. The table is
    emptied between blocks once it holds ``MEMO`` words or ``MEMO_BYTES`` of them.
    """

    def __init__(self, settings: Training, values: np.ndarray):
        super().__init__()
        self.settings, self.values, self.steps = settings, values.astype(np.float64), crc_steps()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new, self.size = [], 0
        self.hashes, self.sums, self.counts = np.array([], np.uint64), np.array([]), np.array([], np.int64)

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.settle()
        return found

    def settle(self) -> None:
        import xxhash

        words, self.new = self.new, []
        if not words:
            return
        self.size += sum(map(len, words))
        sums, counts = self.of_words(words)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.hashes = np.concatenate([self.hashes, hashes])
        self.sums = np.concatenate([self.sums, sums])
        self.counts = np.concatenate([self.counts, counts])

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the words' features: the CRC of the gram at every character, a byte a step."""
        import zlib

        settings, mask = self.settings, self.settings.buckets - 1
        letters = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        begins = (letters & 0xC0) != 0x80  # first bytes of characters
        sizes = np.add.reduceat(begins.astype(np.int64), np.cumsum(sizes) - sizes)
        places = np.append(np.flatnonzero(begins), len(letters))
        firsts = np.cumsum(sizes) - sizes
        room = np.repeat(firsts + sizes, sizes) - np.arange(len(places) - 1)  # characters left in the word
        total, low, high = np.zeros(len(room)), *settings.grams
        for n in range(low, high + 1):
            at = np.flatnonzero(room >= n)
            start = places[at]
            longer = places[at + n] - start
            state = np.full(len(at), n ^ 0xFFFFFFFF, np.uint32)
            for i in range(n):
                state = self.steps[(state ^ letters[start + i]) & 0xFF] ^ (state >> 8)
            for i in range(n, int(longer.max(initial=0))):
                live = np.flatnonzero(longer > i)
                state[live] = self.steps[(state[live] ^ letters[start[live] + i]) & 0xFF] ^ (state[live] >> 8)
            total[at] += self.values[~state & np.uint32(mask)]
        whole = np.fromiter((zlib.crc32(word, 1) for word in words), np.int64, len(words)) & mask
        counts = 1 + sum(np.maximum(0, sizes - n + 1) for n in range(low, high + 1))
        return np.add.reduceat(total, firsts) + self.values[whole], counts


def blocks(found: Iterator[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words of whole texts, some ``BLOCK`` at a time, and the number of words of each text."""
    words, sizes = [], []
    for text in found:
        own = text.split()
        words += own
        sizes.append(len(own))
        if len(words) >= BLOCK:
            yield words, np.array(sizes, np.int64)
            words, sizes = [], []
    if sizes:
        yield words, np.array(sizes, np.int64)


def text_scores(column: pa.Array, features: Features, values: np.ndarray, bias: float, memo: dict) -> np.ndarray:
    """Probability of class 1 of each whole text; a text without words has the bias alone.

    ``memo`` keeps the values of the words of earlier texts.
    """
    settings = features.settings
    if "words" not in memo:
        memo["words"] = WordValues(settings, values)
    known: WordValues = memo["words"]
    means = []
    for words, sizes in blocks(texts(column)):
        if len(known) > MEMO or known.size > MEMO_BYTES:
            known.reset()
        mean = np.zeros(len(sizes))
        if words:
            at = known.numbers(words)
            hashes, total, count = known.hashes[at], known.sums[at], known.counts[at]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            pairs = (joined(hashes[:-1], hashes[1:]) & np.uint64(settings.buckets - 1)).astype(np.int64)
            inside = owner[:-1] == owner[1:]
            total[1:] += np.where(inside, known.values[pairs], 0.0)
            count[1:] += inside
            for d in range(1, settings.reach + 1):
                again = (hashes[:-d] == hashes[d:]) & (owner[:-d] == owner[d:])
                total[d:] += again * known.values[d]
                count[d:] += again
            held = np.flatnonzero(sizes)
            firsts = (np.cumsum(sizes) - sizes)[held]
            mean[held] = np.add.reduceat(total, firsts) / np.add.reduceat(count, firsts)
        means.append(mean)
    mean = np.concatenate(means) if means else np.array([])
    return 1.0 / (1.0 + np.exp(-np.clip(mean + bias, -500, 500)))


def scored(docs: DataFrame, model, column: str = "score", settings: Training = Training(),
           text: str = "text") -> DataFrame:
    """The rows with the probability of class 1; the model's numbers travel once to each executor.

    Null and empty texts get the probability of a text without words; repeated rows and null ids are
    scored like any other; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, memo = Features(settings), {}
        values, bias = sent.value
        for batch in batches:
            found = pa.array(text_scores(batch.column(at), features, values, bias, memo), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, column])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
