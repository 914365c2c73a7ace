"""Quality rules: fixed counts of each text, and a hashed n-gram classifier fitted on labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.llm.shared import as_bytes, blocks, pieces_of, small

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
WINDOW = 3
#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Buckets of each feature family: words, word pairs, 3 and 4 bytes.
BUCKETS = 1 << 14
FAMILIES = 4
BYTE_GRAMS = (3, 4)
#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE = 2_000
#: A text is kept when its calibrated probability of good quality is at least this.
THRESHOLD = 0.3

_random = np.random.default_rng(11)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(31))) * _STEP + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, _STEP))))


@dataclass
class Words:
    """What a stretch of bytes holds: a hash of each word, the word's first byte, code points in words."""

    hashes: np.ndarray
    starts: np.ndarray
    chars: np.ndarray


def _words(data: np.ndarray) -> Words:
    inside = ~_IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, np.zeros(0, np.int64))
    sizes = ends - starts
    at = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    power = _powers(int(sizes.max()))[np.arange(len(at)) - np.repeat(first, sizes)]
    letters = data[at]
    hashes = np.add.reduceat(_BYTE[letters] * power, first)
    return Words(hashes ^ (hashes >> np.uint64(32)), starts, np.add.reduceat(((letters & 0xC0) != 0x80).astype(np.int64), first))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over ``[start, end)``; an empty range gives 0. Each is the same whatever stands around it."""
    out = np.zeros(len(starts), values.dtype)
    full = starts < ends
    if full.any():
        cuts = np.stack((starts[full], ends[full]), axis=1).ravel()
        out[full] = np.add.reduceat(np.concatenate((values, values[:1])), cuts)[::2]
    return out


def _repeated(hashes: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in that text."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(len(firsts), np.int64)
    owner = np.repeat(np.arange(len(firsts)), lasts - firsts)
    whole = owner[: n - WINDOW + 1] == owner[WINDOW - 1 :]
    key = hashes[: n - WINDOW + 1]
    for k in range(1, WINDOW):
        key = _mix(key, hashes[k : n - WINDOW + 1 + k])
    key = _mix(key, owner[: n - WINDOW + 1].astype(np.uint64))
    at = np.flatnonzero(whole)
    _, where, count = np.unique(key[at], return_inverse=True, return_counts=True)
    at = at[count[where] > 1]
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[at + k] = True
    return _sums(covered.astype(np.int64), firsts, lasts)


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


@dataclass
class Block:
    """Features of some texts together: hash values and, for each text, their range."""

    base: np.ndarray  # texts x (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)
    families: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # buckets, firsts, lasts


def _joined(parts: list[Block]) -> Block:
    """The parts of one long text as one text; repeats are counted by the caller."""
    base = np.sum([p.base for p in parts], axis=0)
    families = []
    for k in range(FAMILIES):
        buckets = np.concatenate([p.families[k][0] for p in parts])
        families.append((buckets, np.zeros(1, np.int64), np.array([len(buckets)])))
    return Block(base, families)


def _measure(texts: list[bytes]) -> tuple[Block, Words, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(texts) else sizes
    ends = starts + sizes
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    words = _words(data)
    firsts, lasts = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    symbols = _sums(_IS_SYMBOL[data].astype(np.int64), starts, ends)
    zero = np.zeros(len(texts), np.int64)
    base = np.stack((lasts - firsts, _sums(words.chars, firsts, lasts), symbols, zero, zero), axis=1)
    mask = np.uint64(BUCKETS - 1)
    top = np.uint64(40)
    single = (words.hashes * _STEP) >> top & mask
    pair = _mix(words.hashes[:-1], words.hashes[1:]) >> top & mask
    families = [(single, firsts, lasts), (pair, firsts, np.maximum(firsts, lasts - 1))]
    letters = _BYTE[data]
    for size in BYTE_GRAMS:
        key = letters[: len(data) - size + 1]
        for k in range(1, size):
            key = key * _STEP + letters[k : len(data) - size + 1 + k]
        families.append((key >> top & mask, starts, np.maximum(starts, ends - size + 1)))
    return Block(base, families), words, firsts, lasts


def features(texts: list[bytes]) -> Block:
    """Counts and n-grams of whole texts; one long text is measured in parts cut at white space."""
    if len(texts) == 1 and len(texts[0]) > 2 << 20:
        found = [_measure([part]) for part in pieces_of(texts[0])]
        block = _joined([f[0] for f in found])
        hashes = np.concatenate([f[1].hashes for f in found])
        firsts, lasts = np.zeros(1, np.int64), np.array([len(hashes)])
    else:
        block, words, firsts, lasts = _measure(texts)
        hashes = words.hashes
    block.base[:, 3] = [_repeated_lines(t) for t in texts]
    block.base[:, 4] = _repeated(hashes, firsts, lasts)
    return block


@dataclass
class Classifier:
    """Logistic regression on the mean weight of a text's n-grams, with a calibrated probability.

    ``weights`` has a row per family; ``slope`` and ``offset`` turn the score into a probability.
    """

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, block: Block) -> np.ndarray:
        total = np.full(len(block.base), self.bias)
        for weights, (buckets, firsts, lasts) in zip(self.weights, block.families, strict=True):
            total += _sums(weights[buckets], firsts, lasts) / np.maximum(lasts - firsts, 1)
        return total

    def probabilities(self, block: Block) -> np.ndarray:
        return _sigmoid(self.slope * self.scores(block) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _calibrated(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make scores of held-out rows probabilities: Newton steps, targets
    smoothed by the two class counts so that clean classes give finite values."""
    up, down = good.sum(), (1 - good).sum()
    target = np.where(good == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack((scores, np.ones(len(scores))), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ at)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * at)
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 150) -> Classifier | None:
    """The classifier of rows ``(good, buckets, shares)``, the buckets of all families numbered
    through; every fifth row is held out for calibration. None unless both classes are in both parts."""
    good = np.array([r[0] for r in rows], float)
    held = np.arange(len(rows)) % 5 == 4
    if any(not 0 < good[part].sum() < part.sum() for part in (held, ~held)):
        return None
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) for r in rows])
    index, share = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    use = ~held[row]
    t_row, t_index, t_share = row[use], index[use], share[use]
    weights, bias = np.zeros(FAMILIES * BUCKETS), 0.0
    seen, seen_bias = np.full(FAMILIES * BUCKETS, 1e-8), 1e-8
    each = np.where(good == 1, 0.5 / good[~held].sum(), 0.5 / (1 - good[~held]).sum()) * ~held
    for _ in range(steps):
        p = _sigmoid(bias + np.bincount(t_row, t_share * weights[t_index], len(rows)))
        error = (p - good) * each
        slope = np.bincount(t_index, t_share * error[t_row], len(weights)) + 1e-6 * weights
        seen += slope**2
        weights -= 0.5 * slope / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    scores = bias + np.bincount(row, share * weights[index], len(rows))
    slope, offset = _calibrated(scores[held], good[held])
    return Classifier(weights.reshape(FAMILIES, BUCKETS), bias, slope, offset)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Features of up to ``sample`` labelled rows, chosen by a hash of their ids; ``sample`` bounds
    what is broadcast and what comes to the driver. Null labels and ids are left out; of several
    labels of one id the lowest counts, of several rows of one id one."""
    chosen = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("good"))
        .where("doc_id is not null and good in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("good").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches):
        for batch in small(batches):
            out = []
            for text in as_bytes(batch.column(2)):
                found = [np.unique(b, return_counts=True) for b, _, _ in features([text]).families]
                index = np.concatenate([k * BUCKETS + b.astype(np.int32) for k, (b, _) in enumerate(found)])
                share = np.concatenate([c / max(c.sum(), 1) for _, c in found])
                out.append((index.astype("<i4").tobytes(), share.astype("<f4").tobytes()))
            sparse = [pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sparse], ["doc_id", "good", "buckets", "shares"])

    kind = labels.schema[id_column].dataType.simpleString()
    found = (
        texts.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "good", "text")
        .mapInArrow(run, f"doc_id {kind}, good int, buckets binary, shares binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("buckets", "shares", "good")).alias("one"))
        .select("doc_id", "one.*")
        .toArrow()
    )
    rows = sorted(found.to_pylist(), key=lambda r: r["doc_id"])
    return [(r["good"], np.frombuffer(r["buckets"], "<i4"), np.frombuffer(r["shares"], "<f4")) for r in rows]


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    sample: int = SAMPLE,
) -> Classifier | None:
    return fit(labelled_sample(docs, labels, id_column, text_column, label_column, sample))


def quality_rules(
    docs: DataFrame,
    classifier: Classifier | None,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the base counts, ``base_failed``, ``probability``, ``kept``.

    Counts cover whole texts; a null text counts as empty, has no word and fails the base rules.
    ``base_failed``: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PCT`` percent of them
    in repeated windows of ``WINDOW`` words. ``kept`` is false for these, and otherwise true when the
    calibrated probability reaches ``threshold`` (a tie is kept). Without a classifier, for want of
    labels of both kinds, the probability is null and only the base rules count. Null ids stay,
    repeated rows give repeated rows, other columns are not read. Nothing is shuffled.
    """

    def run(batches):
        for batch in small(batches):
            for a, block in _with_start(blocks(as_bytes(batch.column(1)))):
                found = features(block)
                chance = pa.array(classifier.probabilities(found)) if classifier else pa.nulls(len(block), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(block)), *(pa.array(c) for c in found.base.astype(np.int64).T.copy()), chance],
                    ["doc_id", *counts, "probability"],
                )

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = docs.schema[id_column].dataType.simpleString()
    fields = ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in counts), "probability double"])
    scored = docs.select(F.col(id_column).alias("doc_id"), text_column).mapInArrow(run, fields)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    verdict = F.coalesce(F.col("probability") >= threshold, F.lit(True))
    return scored.select("doc_id", *counts, failed.alias("base_failed"), "probability", (~failed & verdict).alias("kept"))


def keep_good(docs: DataFrame, classifier: Classifier | None, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_rules`` keeps."""
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in small(batches):
            verdict = np.zeros(batch.num_rows, bool)
            for a, block in _with_start(blocks(as_bytes(batch.column(at)))):
                found = features(block)
                words, repeated = found.base[:, 0], found.base[:, 4]
                good = (words >= MIN_WORDS) & (100 * repeated <= MAX_REPEAT_PCT * words)
                if classifier:
                    good &= classifier.probabilities(found) >= threshold
                verdict[a : a + len(block)] = good
            yield batch.filter(pa.array(verdict))

    return docs.mapInArrow(run, docs.schema)


def _with_start(groups: Iterator[list[bytes]]) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    for group in groups:
        yield at, group
        at += len(group)
