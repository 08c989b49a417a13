"""Language identification by hierarchical discrimination (operator 5).

A linear model on hashed byte trigrams first predicts a language family; within it one-versus-one
linear support vector machines separate the related languages by votes.  Both are trained here,
on a bounded sample (``PER_LANGUAGE`` texts a language, evenly chosen by a hash of doc_id) of the texts that may be
learnt from; predictions cover every text in full.

Nulls and edge cases: a null text or one without a letter is ``und`` with score 1; a text of
under three bytes has no trigram and gets the models' biases; rows with a null lang are not learnt
from; with no learnable row at all every text is ``und`` with score 0; a null doc_id counts as the
empty string in the fold; repeated rows are predicted each; columns other than doc_id, text and
lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import cut, table
from helixframe.llm.textbytes import chunks, column, padded, utf8

#: Closely related languages; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "lb", "fy"),
    "nordic": ("da", "no", "nb", "nn", "sv", "is", "fo"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "oc", "ro"),
    "slavic": ("pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk", "ru", "uk", "be"),
}
#: Texts learnt of each language, at most about so many.
PER_LANGUAGE = 750
WIDTH = 2048
#: Rows of a slice: their dense vectors are held at once.
SLICE = 500
_LOW = np.full(256, 32, np.uint8)
_LOW[97:123] = _LOW[65:91] = np.arange(97, 123)
_LOW[128:] = np.arange(128, 256)


def fold(doc_id: Column) -> Column:
    """The contract's remainder; 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def family(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def features(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Unit vectors: square roots of the shares of each text's hashed byte trigrams."""
    data, at = utf8(texts)
    n, low = len(at) - 1, _LOW[data]
    if len(low) < 3:
        return np.zeros((n, width), np.float32)
    gram = padded(low)[: len(low) - 2] & np.uint64(0xFFFFFF)
    slot = ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(at))[: len(slot)]
    last = np.repeat(at[1:], np.diff(at))[: len(slot)]
    good = (np.arange(len(slot)) + 3 <= last) & (gram != 0x202020)
    counts = np.bincount((owner * width + slot)[good], minlength=n * width).reshape(n, width)
    total = np.maximum(1, counts.sum(axis=1, keepdims=True))
    return np.sqrt(counts / total).astype(np.float32)


def train_svm(x: np.ndarray, positive: np.ndarray, c: float = 10.0, steps: int = 300) -> np.ndarray:
    """A linear SVM (squared hinge, classes of equal weight) by accelerated gradient; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * c
    w = ahead = np.zeros(x.shape[1])
    rate = 1.0 / (1.0 + 2.0 * c * 2.0)  # rows have squared norm of at most 2, weights sum to c
    for step in range(steps):
        loss = np.maximum(0.0, 1.0 - y * (x @ ahead))
        gradient = ahead / 1.0 - 2.0 * x.T @ (weight * y * loss)
        after = ahead - rate * gradient
        ahead, w = after + step / (step + 3.0) * (after - w), after
    return w


class Model:
    """Family discriminators, then one-versus-one machines for the languages of each family."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        names = np.array(langs)
        groups = np.array([family(x) for x in langs])
        self.families = sorted(set(groups))
        self.members = {g: sorted(set(names[groups == g])) for g in self.families}
        self.between = self._pairs(x, groups, self.families)
        self.within = {g: self._pairs(x[groups == g], names[groups == g], self.members[g]) for g in self.families}

    @staticmethod
    def _pairs(x: np.ndarray, labels: np.ndarray, names: list[str]) -> list[tuple[int, int, np.ndarray]]:
        out = []
        for a, b in combinations(range(len(names)), 2):
            mine = (labels == names[a]) | (labels == names[b])
            out.append((a, b, train_svm(x[mine], labels[mine] == names[a])))
        return out

    @staticmethod
    def _vote(x: np.ndarray, pairs: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, margins deciding ties, and its confidence: its weakest pair's logistic margin."""
        votes, margins, worst = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), 20.0)
        for a, b, w in pairs:
            m = x @ w[:-1] + w[-1]
            for k, s in ((a, m), (b, -m)):
                votes[:, k] += s > 0
                margins[:, k] += np.tanh(s)
                worst[:, k] = np.minimum(worst[:, k], s)
        best = np.argmax(votes + 1e-3 * margins, axis=1)
        return best, 1.0 / (1.0 + np.exp(-4.0 * np.clip(worst[np.arange(len(x)), best], -20.0, 20.0)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, sure = self._vote(x, self.between, len(self.families))
        lang, score = np.empty(len(x), object), sure.copy()
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(top == k)
            if len(rows):
                best, inner = self._vote(x[rows], self.within[name], len(self.members[name]))
                lang[rows] = np.array(self.members[name], object)[best]
                score[rows] *= inner
        return lang, score


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, rows=SLICE):
        rows = features(column(part, "text"))
        yield pa.RecordBatch.from_arrays([column(part, "lang"), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "x"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Train on about ``per_language`` texts of each language, drawn by a hash of id and text.

    A draw is shared by repeated rows, which are learnt once, so that no id or text fills the sample.
    """
    learn = docs.select("doc_id", "lang", "text").where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(F.col("lang").alias("drawn_lang"), (per_language / F.col("n")).alias("share"))
    counts = cut(counts, "lang-counts")  # read from a file, so the plan knows its size and texts are not shuffled for it
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    # A row a language: a table of its own, not an expression, so that any number of languages will do.
    sample = learn.withColumn("draw", draw).join(counts, (F.col("lang") == F.col("drawn_lang")) & (F.col("draw") < F.col("share")))
    sample = sample.select("doc_id", "lang", "text").distinct().select("lang", "text").mapInArrow(_featurise, "lang string, x binary")
    rows = sorted((r["lang"], bytes(r["x"])) for r in sample.collect())
    x = np.stack([np.frombuffer(v, np.float32) for _, v in rows]) if rows else np.zeros((0, WIDTH), np.float32)
    return Model(x, [lang for lang, _ in rows]) if rows else None


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, rows=SLICE):
            text = column(part, "text")
            readable = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            else:
                lang, score = model.predict(features(text))
                lang[~readable], score[~readable] = "und", 1.0
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.  Without a ``model`` one is trained on ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = model or fit(rows)
    rows = rows.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _accept(model: Model | None):
    judge = _predict(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "text"), pa.array(np.zeros(part.num_rows, bool))], ["doc_id", "text", "held_out"])
            lang = pa.concat_arrays([column(x, "lang_pred") for x in judge(iter([rows]))])
            yield part.filter(pc.not_equal(lang, "und"))

    return run


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a language (no letter, or no text) go; the others stay as they are."""
    return docs.mapInArrow(_accept(fit(docs)), docs.schema)


def op5_language_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
