"""Language-model scores by subword lattices.

Pieces and their first weights come from an existing vocabulary with scores. A word's
probability is the sum over all its segmentations into pieces of the products of the pieces'
probabilities, by a forward recursion in log space; any character may also be spelt in bytes, so
every text has a probability. Words are independent, and each text closes with one end. The
pieces' probabilities are re-estimated by expectation-maximisation on all training words, with
the vocabulary's own weights as the prior.

Defined results: a null or empty text is its end alone. Repeated rows are scored and learned
from each for itself; a row with a null id is scored but not learned from. With nothing to learn
from, the vocabulary's weights stand, and base scores those of no counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .frequencies import document_sums, word_counts

START = "▁"
ROUNDS = 3
#: Pseudo-counts that the vocabulary's weights are worth in all.
PRIOR = 1000.0
#: Words whose lattices are computed together, words taken in for that, and longest word computed so.
STEP, TAKEN, LONG = 8_000, 60_000, 48


class Vocabulary:
    """Pieces of a sentencepiece file. A merge order, as byte-pair files keep for scores, is a
    rank, which Zipf's law turns into a weight; log probabilities are kept as they are."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.bytes, scores = {}, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = len(scores)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            else:
                self.ids[piece] = len(scores)
            scores.append(model.get_score(i))
        for b in range(256):
            if b not in self.bytes:
                self.bytes[b] = len(scores)
                scores.append(min(scores, default=0.0) - 1)
        self.end = len(scores)
        self.longest = max(map(len, self.ids), default=1)
        self.table = _Table(self.ids)
        scores = np.array([*scores, max(scores, default=0.0)])
        weights = np.exp(scores) if scores.min() > -50 else 1 / (2 + scores.max() - scores)
        for b in self.bytes.values():
            weights[b] = weights.min()
        self.log_p = np.log(weights / weights.sum())

    def __len__(self) -> int:
        return self.end + 1


class _Table:
    """Pieces by a 64-bit hash of their characters, with open addressing, for whole arrays at once."""

    PRIME, SLOTS = np.uint64(0x9E3779B97F4A7C15), 1 << 18

    def __init__(self, ids: dict[str, int]):
        while self.SLOTS < 4 * len(ids):
            self.SLOTS *= 2
        self.keys, self.ids = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        by_length = defaultdict(list)
        for piece in ids:
            by_length[len(piece)].append(piece)
        for size, pieces in by_length.items():
            code = _codes(pieces, size)
            h = np.zeros(len(pieces), np.uint64)
            for k in range(size):
                h = h * self.PRIME + code[k]
            for piece, key in zip(pieces, self.mixed(h, size)):
                at = int(key) % self.SLOTS
                while self.ids[at] >= 0:
                    at = (at + 1) % self.SLOTS
                self.keys[at], self.ids[at] = key, ids[piece]

    def mixed(self, h: np.ndarray, size: int) -> np.ndarray:
        h = (h + np.uint64(size)) * self.PRIME
        return h ^ (h >> np.uint64(32))

    def find(self, h: np.ndarray, size: int) -> np.ndarray:
        """Ids of pieces of this size by their unmixed hashes; -1 where there is none."""
        key = self.mixed(h, size)
        at = (key % np.uint64(self.SLOTS)).astype(np.int64)
        found = np.where(self.keys[at] == key, self.ids[at], -1)
        left = np.nonzero((self.keys[at] != key) & (self.ids[at] >= 0))
        while len(left[0]):
            at[left] = (at[left] + 1) % self.SLOTS
            now = self.keys[at[left]] == key[left]
            found[left] = np.where(now, self.ids[at[left]], -1)
            more = ~now & (self.ids[at[left]] >= 0)
            left = tuple(x[more] for x in left)
        return found


def _codes(words: list[str], size: int) -> np.ndarray:
    """Code points of words of one length: a row for each place, a column for each word."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return np.ascontiguousarray(flat.reshape(len(words), size).T).astype(np.uint64)


class Lattice:
    """Forward and backward sums over words, given the pieces' log probabilities."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray):
        self.v, self.log_p = vocabulary, log_p

    def spelling(self, char: str) -> list[int]:
        return [self.v.bytes[b] for b in char.encode()]

    def log_words(self, words: list[str], counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log probability of each word; with counts, also the pieces' expected counts."""
        out, expected = np.zeros(len(words)), np.zeros(len(self.v))
        by_length = defaultdict(list)
        for i, w in enumerate(words):
            by_length[len(w)].append(i)
        for length, own in by_length.items():
            if length > LONG:
                for i in own:
                    out[i] = self._alone(START + words[i], 0 if counts is None else counts[i], expected)
                continue
            for k in range(0, len(own), STEP):
                part = own[k : k + STEP]
                n = None if counts is None else np.array([counts[i] for i in part], float)
                out[part] = self._together([START + words[i] for i in part], length + 1, n, expected)
        return out, expected

    def _together(self, words, size, n, expected):
        """Words of one length. An edge is kept with the words that have its piece."""
        code = _codes(words, size)
        chars, letter = np.unique(code, return_inverse=True)
        letter = letter.reshape(code.shape)
        spelt = [self.spelling(chr(c)) for c in chars]
        spell = np.array([self.log_p[s].sum() for s in spelt])[letter]
        into, out_of = defaultdict(list), defaultdict(list)
        h = np.zeros_like(code)
        for m in range(1, min(size, self.v.longest) + 1):
            h = h[: size - m + 1] * _Table.PRIME + code[m - 1 :]
            found = self.v.table.find(h, m)
            for i in range(size - m + 1):
                rows = np.flatnonzero(found[i] >= 0)
                if len(rows):
                    ids = found[i][rows]
                    edge = (i, i + m, rows, ids, self.log_p[ids])
                    into[i + m].append(edge)
                    out_of[i].append(edge)
        ahead = np.full((size + 1, len(words)), -np.inf)
        ahead[0] = 0.0
        for j in range(1, size + 1):
            total = ahead[j - 1] + spell[j - 1]
            for i, _, rows, _, weight in into[j]:
                total[rows] = np.logaddexp(total[rows], ahead[i][rows] + weight)
            ahead[j] = total
        if n is not None:
            back = np.full((size + 1, len(words)), -np.inf)
            back[size] = 0.0
            pieces, shares = [], []
            by_char = np.zeros(len(chars))
            for i in range(size - 1, -1, -1):
                spelled = back[i + 1] + spell[i]
                total = spelled.copy()
                start = ahead[i] - ahead[size]
                for _, j, rows, ids, weight in out_of[i]:
                    way = back[j][rows] + weight
                    total[rows] = np.logaddexp(total[rows], way)
                    pieces.append(ids)
                    shares.append(np.exp(start[rows] + way) * n[rows])
                by_char += np.bincount(letter[i], np.exp(start + spelled) * n, len(chars))
                back[i] = total
            if pieces:
                expected += np.bincount(np.concatenate(pieces), np.concatenate(shares), len(expected))
            for c, s in enumerate(spelt):
                np.add.at(expected, s, by_char[c])
        return ahead[size]

    def _alone(self, word: str, n: int, expected: np.ndarray) -> float:
        """One long word, place by place."""
        get, log_p, size, longest = self.v.ids.get, self.log_p, len(word), self.v.longest
        spelt = {c: (self.spelling(c), float(log_p[self.spelling(c)].sum())) for c in set(word)}
        edges = []
        ahead = [0.0] * (size + 1)
        for j in range(1, size + 1):
            ways = [(j - 1, -1, spelt[word[j - 1]][1])]
            for i in range(max(0, j - longest), j):
                piece = get(word[i:j])
                if piece is not None:
                    ways.append((i, piece, float(log_p[piece])))
            terms = [ahead[i] + w for i, _, w in ways]
            most = max(terms)
            ahead[j] = most + math.log(sum(math.exp(t - most) for t in terms))
            edges.append(ways)
        if n:
            share = [0.0] * size + [float(n)]  # of all segmentations, those with an end here
            for j in range(size, 0, -1):
                if share[j]:
                    for i, piece, w in edges[j - 1]:
                        x = share[j] * math.exp(ahead[i] + w - ahead[j])
                        share[i] += x
                        np.add.at(expected, spelt[word[j - 1]][0] if piece < 0 else piece, x)
        return ahead[size]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The process's own copy of a vocabulary."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about TAKEN words, so that words of one length are many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TAKEN or sum(b.nbytes for b in held) >= common.STEP_CHARS:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def learn(table: DataFrame, n_ends: int, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end, from ``word``, ``n_learn`` of a word table.
    A round brings one row for each piece to the driver, whatever the input."""
    v = vocabulary(path)
    prior = PRIOR * np.exp(v.log_p)
    log_p = v.log_p
    spark = table.sparkSession
    learned = table.filter("n_learn > 0").select("word", "n_learn")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(vocabulary(path), shared.value)
            total = np.zeros(len(lattice.v))
            for table in _gathered(batches):
                words = [x.decode() for x in table.column("word").to_pylist()]
                total += lattice.log_words(words, table.column("n_learn").to_pylist())[1]
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["piece", "n"])

        rows = learned.mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = prior.copy()
        counts[rows.column("piece").to_numpy()] += rows.column("n").to_numpy()
        counts[v.end] += n_ends
        log_p = np.log(counts / counts.sum())
    return log_p


def score(docs: DataFrame, path: str, learns, rounds: int = ROUNDS) -> DataFrame:
    """docs' columns but text (and any of the names that follow), with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``; ``learns`` is the condition of the rows to learn from."""
    counted = docs.select("text", learns.alias("learn"))
    table = common.cut(word_counts(counted, lower=True))
    n_ends = docs.filter(learns).count()
    words, distinct = table.agg(F.sum("n_learn"), F.count(F.when(F.col("n_learn") > 0, 1))).first()
    total = (words or 0) + n_ends
    log_p = learn(table, n_ends, path, rounds)
    room = total + 0.5 * (distinct + (n_ends > 0) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(log_p)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(vocabulary(path), shared.value)
        for batch in _gathered(batches):
            logs = lattice.log_words([x.decode() for x in batch.column("word").to_pylist()])[0]
            c = batch.column("n_learn").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array((c > 0).astype(np.int64)),
                 pa.array(np.log10((c + 0.5) / room)), pa.array(logs / math.log(10))],
                names=["word", "n", "known", "base", "model"],
            )

    values = common.cut(table.mapInArrow(weigh, "word binary, n long, known long, base double, model double"))
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = common.without(docs.columns, ["text", *results])
    sums = document_sums(docs, kept, values, ["known", "base", "model"], lower=True)
    sums = sums.toDF(*(f"__c{i}" for i in range(len(kept))), "n_words", "known", "base", "model")
    end_base, end_model = math.log10((n_ends + 0.5) / room), float(log_p[vocabulary(path).end]) / math.log(10)
    return sums.select(
        *(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)),
        (F.col("n_words") + 1).cast("long").alias("n_tokens"),
        (F.col("known") + int(n_ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("model") + end_model).alias("score"),
    )
