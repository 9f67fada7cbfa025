"""Quality classifier: Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one is preferred to a bad one); logistic loss on the difference of their
features is minimised, so a document's score is a strength. The threshold is a quantile of the strengths of the training
documents, placed at the share of bad ones, and the strengths are mapped to (0, 1) such that the threshold lies at `cut`.

The model is fitted on the driver from at most MAX_LABELLED labelled documents, those with the smallest hash of their id, whatever
the corpus holds; all counts of a text cover the whole text, however long. Scoring is one pass without a shuffle. Equal strengths get equal scores.

A null text counts as empty; empty texts get the score of their features, all zero. Labels that are null are not used. Without
labels of both classes every score is 0.5. Repeated rows get equal scores; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_slices
from .textbytes import per_document, text_bytes, word_bounds, word_hashes

MAX_LABELLED, PAIRS_EACH, CUT = 20_000, 20, 0.7


def _flags(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LOWER, _DIGIT, _HIGH = _flags(range(65, 91)), _flags(range(97, 123)), _flags(range(48, 58)), _flags(range(128, 256))
_LINE, _END, _SYMBOL = _flags(b"\n"), _flags(b".!?"), _flags(b"#$%&*+/<=>@[\\]^_`{|}~")
NAMES = (
    "log_words word_length log_lines upper digits symbols exclamations pipes commas ends repeats repeats2 repeats_far upper_words symbol_words lone_symbols long_words line_words distinct top_word repeated_lines high".split()
)


def features(texts: pa.Array) -> np.ndarray:
    """One row of len(NAMES) numbers a text: shares of kinds of characters, words, repeats and lines."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = word_bounds(raw, offsets)
    size, words = np.diff(offsets), np.diff(first)
    some, any_word = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda mask: per_document(mask[raw], offsets) / some
    ratio = lambda values: per_document(values, first) / any_word
    hashes = word_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(len(words)), words)

    def same(step: int) -> np.ndarray:
        hit = np.zeros(len(hashes), bool)
        hit[step:] = (hashes[step:] == hashes[:-step]) & (doc[step:] == doc[:-step])
        return hit

    kind = lambda mask: np.add.reduceat(mask[raw].astype(np.int32), starts)[: len(starts)] if len(starts) else np.zeros(0, np.int32)
    # reduceat runs to the next word's start: white space between belongs to no kind counted here
    length = ends - starts
    upper, lower, symbol, pipe = kind(_UPPER), kind(_LOWER), kind(_SYMBOL | _flags(b"!")), kind(_flags(b"|"))
    far = np.zeros(len(hashes), bool)
    for step in range(3, 13):
        far |= same(step)
    lines = per_document(_LINE[raw], offsets) + (size > 0)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    runs = np.flatnonzero(new)
    run_length = np.diff(np.append(runs, len(order)))
    run_first = np.searchsorted(doc[order][runs], np.arange(len(words) + 1)) if len(runs) else np.zeros(len(words) + 1, np.int64)
    # a line's hash is the sum of its words' hashes
    line_of = np.cumsum(np.concatenate([[0], _LINE[raw]]))[starts] + doc if len(starts) else np.zeros(0, np.int64)
    line_start = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(line_of) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(hashes, line_start) if len(line_start) else np.zeros(0, np.uint64)
    line_doc = doc[line_start]
    by = np.lexsort((line_hash, line_doc))
    again = np.zeros(len(by), bool)
    again[1:] = (line_hash[by][1:] == line_hash[by][:-1]) & (line_doc[by][1:] == line_doc[by][:-1])
    line_first = np.searchsorted(line_doc[by], np.arange(len(words) + 1))
    out = [
        np.log1p(words), ratio(length) / 10, np.log1p(lines), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_flags(b"!")), share(_flags(b"|")), share(_flags(b",")), share(_END),
        ratio(same(1)), ratio(same(2)), ratio(far), ratio((upper >= 2) & (lower == 0)), ratio(symbol > 0), ratio((pipe > 0) & (length == 1)), ratio(length > 15), np.log1p(words / np.maximum(lines, 1)),
        per_document(new, first) / any_word, per_document(run_length, run_first, np.maximum) / any_word, per_document(again, line_first) / np.maximum(1, np.diff(line_first)), share(_HIGH),
    ]
    return np.column_stack([np.asarray(x, float) for x in out]) if len(texts) else np.zeros((0, len(NAMES)))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id is hashed as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, usable: Column, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label, text) of at most `most` labelled documents, one row each: those with the smallest hash of their id. The ids are few, so they are broadcast.

    Of several rows with one id the smallest text is taken, of several labels the greatest.
    """
    ids = labels.where(usable & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("label"))
    chosen = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


class BradleyTerry:
    """Strengths w.x of standardised features, fitted on pairs, and their map to (0, 1)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float, cut: float = CUT):
        self.mean, self.scale, self.weights, self.threshold, self.cut = mean, scale, weights, threshold, cut

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3, cut: float = CUT, rounds: int = 60) -> BradleyTerry:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.clip((x - mean) / scale, -8, 8)
        rng = np.random.default_rng(7)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
        n = pairs_each * max(len(good), len(bad))
        d = z[rng.permutation(np.resize(good, n))] - z[rng.permutation(np.resize(bad, n))]
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps on the mean logistic loss of the differences
            p = 1 / (1 + np.exp(d @ w))
            gradient = d.T @ p / n - ridge * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / n + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        strength = np.sort(z @ w)
        k = len(bad)  # the quantile at the share of bad documents, halfway to the next strength
        return cls(mean, scale, w, float((strength[k - 1] + strength[min(k, len(strength) - 1)]) / 2), cut)

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.threshold + shift, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, most: int = MAX_LABELLED) -> BradleyTerry | None:
    """The model of the labelled rows outside the held-out part; None without both classes."""
    schema = "label int, x array<double>"

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(batch.column(1))), pa.list_(pa.float64()))], ["label", "x"])

    sample = labelled_sample(docs, labels, "quality", ~held_out("doc_id", parts, part), most)
    rows = map_slices(sample.select("label", "text"), "text", measure, schema).toPandas()  # at most `most` short rows
    if rows["label"].nunique() < 2:
        return None
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy()
    order = np.lexsort((*x.T, y))
    return BradleyTerry.fit(x[order], y[order])


def weigher(model: BradleyTerry | None) -> Callable[[pa.Array], np.ndarray]:
    """The score of each text, for operators that weigh documents by quality; 0.5 for all without a model."""
    return lambda texts: model.score(features(texts)) if model else np.full(len(texts), 0.5)


def scored(docs: DataFrame, model: BradleyTerry | None, columns: list[str], schema: str, score: str) -> DataFrame:
    """`columns` of docs (text among them or not) with the score of each text."""
    read = columns if "text" in columns else [*columns, "text"]
    at, weigh = read.index("text"), weigher(model)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(weigh(batch.column(at)))], [*columns, score])

    return map_slices(docs.select(*read), "text", measure, f"{schema}, `{score}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scored(docs, train(docs, labels, parts, part), ["doc_id"], "doc_id long", "score")
    return out.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, whatever their names."""
    model, score = train(docs, labels, parts, part), free_names(docs.columns, "quality_score")[0]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return scored(docs, model, docs.columns, fields, score).where(F.col(score) >= CUT).select(docs.columns)
