"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased and letters alone are kept, every other run as one space. The n-grams of one to three characters
fall into ``buckets`` by a hash. Document frequencies come from every training document; the regression is trained on
a bounded sample of them by follow-the-regularised-leader with elastic-net penalties, and its scores are calibrated
with one temperature on sample rows that the training leaves out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, drop, text_or_empty

BUCKETS = 1 << 13
SAMPLE_ROWS = 4000  # training rows at most
MAX_LANGUAGES = 512  # label values that are learned at most, the most frequent ones
EPOCHS = 3
BATCH = 64
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.2, 1e-4  # L1 leaves about a fifth of the weights
CHUNK = 1 << 18
ROWS_AT_ONCE = 128
_ORDERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or a space."""
    if not _LETTERS:
        table = np.full(1 << 16, ord(" "), dtype=np.uint32)
        for i in range(1 << 16):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                table[i] = min(ord(chr(i).lower()[0]), 0xFFFF)
        _LETTERS.append(table)
    return _LETTERS[0]


def letter_blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of the text's letters with one space between words and at the ends; nothing without letters.

    A block comes from CHUNK characters of the text, so a text of any length takes bounded memory.
    """
    table, last = _letters(), 0
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        low = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], np.uint32(ord(" ")))
        high = np.flatnonzero(points >= len(table))
        if len(high):
            low[high] = [p if chr(p).isalpha() else 32 for p in points[high]]
        space = low == 32
        if not last and space.all():
            continue
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        keep[0] = not space[0] or last != 32
        low = low[keep]
        if not last and low[0] != 32:
            low = np.concatenate([[32], low])
        if len(low):
            last = int(low[-1])
            yield low.astype(np.uint64)
    if last not in (0, 32):
        yield np.array([32], dtype=np.uint64)


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's n-grams occur in the text; all zero if it has no letter."""
    total, held = np.zeros(buckets), np.empty(0, dtype=np.uint64)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for block in letter_blocks(text):
        part = key = np.concatenate([held, block])
        for order, odd in enumerate(_ORDERS):  # n-grams that end in the new block
            if order:
                if len(part) <= order:
                    break
                key = (key[:-1] << np.uint64(21)) | part[order:]
            new = key[max(0, len(held) - order) :]
            total += np.bincount(((new * odd) >> shift).astype(np.int64), minlength=buckets)
        held = part[-2:]
    return total


def features(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF rows of count rows; term frequencies are damped by a logarithm."""
    x = np.log1p(count) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets * languages
    temperature: float
    floor: float = 0.0  # scores below are a toss-up

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        for at in range(0, len(texts), ROWS_AT_ONCE):
            count = np.stack([counts(t, len(self.idf)) for t in texts[at : at + ROWS_AT_ONCE]])
            p = softmax(features(count, self.idf) @ self.weights / self.temperature)
            for i in np.flatnonzero(count.any(axis=1)):
                best = int(p[i].argmax())
                langs[at + i], scores[at + i] = self.languages[best], float(min(1.0, p[i, best]))
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Rows:
    """Sparse count rows: the buckets and counts of row i are those from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    at: np.ndarray
    n: np.ndarray

    def features(self, rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
        """Dense features of a few rows."""
        out = np.zeros((len(rows), len(idf)))
        for line, r in zip(out, rows, strict=True):
            part = slice(self.starts[r], self.starts[r + 1])
            line[self.at[part]] = self.n[part]
        return features(out, idf)


def ftrl(x: Callable[[np.ndarray], np.ndarray], y: np.ndarray, width: int, classes: int, epochs: int = EPOCHS, l1: float = L1) -> np.ndarray:
    """Weights by proximal follow-the-regularised-leader, in small batches with one rate per coordinate.

    x: gives the dense feature rows of some row numbers; y: the class of every row.
    """
    z = np.zeros((width, classes))
    squares = np.zeros_like(z)
    target = np.eye(classes)[y]

    def current() -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(squares)) / ALPHA + L2))

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            w, dense = current(), x(rows)
            gradient = dense.T @ (softmax(dense @ w) - target[rows])
            sigma = (np.sqrt(squares + gradient**2) - np.sqrt(squares)) / ALPHA
            z += gradient - sigma * w
            squares += gradient**2
    return current()


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, on a grid from 0.02 to 5.

    Rows count as right with probability 1 - 1 / (rows + 2), so that separable rows don't ask for endless certainty.
    """
    if not len(y) or scores.shape[1] < 2:
        return 1.0
    grid, doubt = np.geomspace(0.02, 5, 80), 1 / (len(y) + 2)
    target = np.full(scores.shape, doubt / (scores.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - doubt
    losses = [-(target * np.log(np.maximum(softmax(scores / t), 1e-300))).sum(axis=1).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def _scanned(rows: DataFrame, buckets: int) -> DataFrame:
    """What training needs of rows (text, lang, chosen), from one scan: (bucket, n) document frequencies of each task,
    bucket -1 being its documents, and (key, lang, at, n_at) sparse counts of each chosen row. No text leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "n", "key", "lang", "at", "n_at"]
        total, size = np.zeros(buckets, dtype=np.int64), 0
        for batch in batches:
            keys, langs, places, times = [], [], [], []
            for text, lang, chosen in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                count = counts(text, buckets)
                total += count > 0
                size += 1
                if chosen.as_py():
                    at = np.flatnonzero(count)
                    keys.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                    langs.append(lang.as_py())
                    places.append(at.astype("<u2").tobytes())
                    times.append(np.minimum(count[at], 65535).astype("<u2").tobytes())
            nothing = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing.cast(pa.int32()), nothing, pa.array(keys, pa.binary()), pa.array(langs, pa.string()), pa.array(places, pa.binary()), pa.array(times, pa.binary())], names)
        at = np.flatnonzero(total)
        none = [pa.nulls(len(at) + 1, t) for t in (pa.binary(), pa.string(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], type=pa.int32()), pa.array([*total[at], size], type=pa.int64()), *none], names)

    return rows.mapInArrow(run, "bucket int, n long, key binary, lang string, at binary, n_at binary")


def fit(train: DataFrame, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS, l1: float = L1, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model from rows (text, lang) with lang not null. An empty table gives a model that answers 'und'.

    Document frequencies and class sizes cover all rows. The regression sees at most ``sample_rows`` of them: of each
    language an equal share, the rows whose text hash falls below the share's part of the language, each text once.
    A row of the sample takes 4 bytes for each bucket that it has, so one task trains on 4 * buckets * sample_rows
    bytes at most (128 MB with the defaults, about a tenth in practice), however long the texts are. ``buckets`` may
    be 65,536 at most. The sample holds the ``max_languages`` label values with the most rows, ties by name, so weights
    take 8 * buckets * max_languages bytes at most (32 MB); rows of rarer values, as a dirty label column has them,
    count for the document frequencies alone. The model's floor lies a third of the way from a toss-up to the lowest score of a calibration
    row that is answered right.
    """
    spark = train.sparkSession
    rows = train.select(text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    sizes = {r["lang"]: r["n"] for r in most.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(buckets), np.zeros((buckets, 0)), 1.0)
    share = sample_rows / len(languages)
    parts = spark.createDataFrame([(k, min(1.0, 0.9 * share / n) * 2.0**64 - 2.0**63) for k, n in sizes.items()], "lang string, below double")
    below = F.coalesce(F.xxhash64("text").cast("double") < F.col("below"), F.lit(False))
    chosen = rows.join(F.broadcast(parts), "lang", "left").select("text", "lang", below.alias("chosen"))
    scanned = cut(_scanned(chosen, buckets), "language")

    seen = {r["bucket"]: r["n"] for r in scanned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    size = seen.pop(-1, 0)
    document = np.zeros(buckets)
    document[list(seen)] = list(seen.values())
    idf = np.log((1 + size) / (1 + document)) + 1

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("lang", "ascending")])[:sample_rows]
        packed = {name: table.column(name).combine_chunks() for name in ("at", "n_at")}
        at, n = (np.frombuffer(b"".join(x.as_py() for x in packed[name]), dtype="<u2") for name in ("at", "n_at"))
        lengths = np.array([len(x.as_py()) // 2 for x in packed["at"]], dtype=np.int64)
        sample = Rows(np.concatenate([[0], np.cumsum(lengths)]), at, n)
        y = np.array([languages.index(k) for k in table.column("lang").to_pylist()], dtype=np.int64)
        order = np.random.default_rng(0).permutation(len(y))
        part = len(y) - len(y) // 5
        w = ftrl(lambda r: sample.features(order[r], idf), y[order[:part]], buckets, len(languages), l1=l1)
        held = order[part:]
        scores = np.concatenate([np.zeros((0, len(languages))), *(sample.features(held[i : i + BATCH], idf) @ w for i in range(0, len(held), BATCH))])
        t = temperature(scores, y[held])
        p, floor = softmax(scores / t), 1 / len(languages)
        right = p.argmax(axis=1) == y[held]
        if right.any():
            floor += (float(p[right].max(axis=1).min()) - floor) / 3
        kept = np.flatnonzero(np.abs(w).sum(axis=1))
        return pa.table({"bucket": pa.array([*kept, -1], pa.int32()), "w": pa.array([*w[kept].tolist(), [t, floor]], pa.list_(pa.float64()))})

    sample = scanned.where("key IS NOT NULL").dropDuplicates(["key", "lang"]).select(F.lit(1).alias("one"), "key", "lang", "at", "n_at")
    weights, heat, floor = np.zeros((buckets, len(languages))), 1.0, 0.0
    for r in sample.groupBy("one").applyInArrow(learn, "bucket int, w array<double>").collect():
        if r["bucket"] >= 0:
            weights[r["bucket"]] = r["w"]
        else:
            heat, floor = r["w"]
    drop(scanned)
    return Model(languages, idf, weights, heat, floor)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and columns ``keep``), lang_pred, score of every row.

    The text alone is looked at, whole. A null text or one without a letter is 'und' with score 0; a null doc_id is
    kept; repeated rows stay; an empty table gives an empty result; columns not kept are ignored.
    """

    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for at in range(0, len(texts), ROWS_AT_ONCE):  # texts as Python strings take several times their bytes
            found = model.predict([t or "" for t in texts.slice(at, ROWS_AT_ONCE).to_pylist()])
            langs += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], ["lang_pred", "score"])

    named = F.arrow_udf(run, "struct<lang_pred: string, score: double>")
    columns = [F.col(c) for c in ["doc_id", *(keep or [])]]
    return docs.select(*columns, named(F.col("text").cast("string")).alias("__named")).select(*columns, "__named.lang_pred", "__named.score")


def held_out() -> Column:
    """Rows that training never sees. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def trained(docs: DataFrame) -> Model:
    """A model from the labelled documents that are not held out."""
    return fit(docs.where(F.col("lang").isNotNull() & ~held_out()))
