"""Operator 6: toxicity by a classifier chain.

A chain has a linear (logistic) model per category, in a fixed order. Each later model gets the earlier categories'
log-odds, over those of a text without any feature, as inputs; in training these are out-of-fold predictions of ``FOLDS`` folds, so a later model learns from what an
earlier one does on texts it has not seen. Every model of a fold has features of its own, chosen without the rows it
predicts. The label table has no finer categories than toxic and quality, so the query's chain is: toxic prose (toxic,
quality 1), toxic junk (toxic, quality 0), toxic; a document is rejected by the last, above the threshold with the best
out-of-fold F1, and only if its odds are above those of a text without any feature.

Inputs are the presence of a text's lower-case words (runs of letters) and of their prefixes of 4 to 6 letters. A model's features
are those that differ between toxic and other training rows by a likelihood-ratio test (``SIGNIFICANT``), in either
direction. Scoring splits every whole text by Arrow and looks up each distinct word once.

The training rows are at most ``max_train`` labelled documents, those with the least hash of their id (documented bound;
these labels are the only data that is broadcast, and the features are among their words).

Defined cases: null or empty text has no word and gets the models' base rates; repeated rows get equal results; labels
that are null or refer to no document are ignored; of several labels of a document, toxic holds if one says so, and
quality 0 likewise; a null quality is 1; a document that is there several times trains once, by its least text; without
labels, or with labels of one kind only, no document is rejected; scores equal to the threshold are not rejected; an empty
table gives an empty result. Other columns are ignored, and kept by :func:`drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.llm._shared import materialize

MAX_TRAIN = 20_000
FOLDS = 5
#: Likelihood ratio that chance exceeds once in a thousand (chi-square, one degree of freedom); a fixed value.
SIGNIFICANT = 10.83
L2 = 1e-4
#: Bytes of text whose words are Arrow arrays at a time.
SLICE_BYTES = 2 << 20
BETWEEN = r"[^\p{L}]+"
PREFIXES = (4, 5, 6)
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and for each occurrence its text and its word."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(low, BETWEEN)
    flat = lists.flatten().dictionary_encode()
    return flat.dictionary, np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy()), flat.indices.to_numpy()


def token_lists(texts: pa.Array) -> pa.Array:
    """Distinct tokens of each text: its words and, marked by ^, their prefixes."""
    distinct, row, word = words(texts)
    size = pc.utf8_length(distinct).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, np.int64)
    kinds = [distinct] + [pc.binary_join_element_wise(pa.scalar("^", pa.large_string()), pc.utf8_slice_codeunits(distinct, 0, n), pa.scalar("", pa.large_string())) for n in PREFIXES]
    coded = pa.concat_arrays(kinds).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64).reshape(len(kinds), len(distinct))
    there = [size >= n for n in (1, *PREFIXES)]
    pair = np.unique(row * max(len(distinct), 1) + word)
    row, word = pair // max(len(distinct), 1), pair % max(len(distinct), 1)
    width = max(len(coded.dictionary), 1)
    code = np.unique(np.concatenate([row[ok[word]] * width + n[word[ok[word]]] for n, ok in zip(number, there)]))
    return _lists(code // width, coded.dictionary.take(pa.array(code % width)).cast(pa.string()), len(texts))


def _lists(row: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """The values by row; ``row`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), values)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Neighbouring texts of at most ``SLICE_BYTES``, or one longer text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield texts.slice(at, to - at)
        at = to


# --- the linear models ----------------------------------------------------------------------------------------------


class Sparse:
    """Active features as pairs (row, feature), each once."""

    def __init__(self, row: np.ndarray, col: np.ndarray, n: int, width: int):
        self.row, self.col, self.n, self.width = row, col, n, width

    def only(self, chosen: np.ndarray) -> Sparse:
        ok = chosen[self.col]
        return Sparse(self.row[ok], self.col[ok], self.n, self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def dot_t(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Sparse, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = L2) -> np.ndarray:
    """The minimum of the mean logistic loss plus ``l2`` / 2 times the squared weights, by Newton steps whose systems
    conjugate gradients solve; the result is feature weights, weights of ``extra`` and a bias (not shrunk)."""
    k, n, total = extra.shape[1], x.width, weight.sum()
    w = np.zeros(n + k + 1)
    if not total or not y[weight > 0].any() or y[weight > 0].all():
        w[-1] = 30.0 if total and y[weight > 0].all() else -30.0
        return w
    weight, shrink = weight / total, np.r_[np.full(n + k, l2), 0.0]
    rate = float(y @ weight)
    w[-1] = np.log(rate / (1 - rate))

    def up(v: np.ndarray) -> np.ndarray:
        return x.dot(v[:n]) + extra @ v[n:-1] + v[-1]

    def down(g: np.ndarray) -> np.ndarray:
        return np.concatenate([x.dot_t(g), extra.T @ g, [g.sum()]])

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * (shrink * v) @ v)

    z = up(w)
    value = loss(w, z)
    for _ in range(100):
        p = _sigmoid(z)
        slope = down(weight * (p - y)) + shrink * w
        steep = float(np.linalg.norm(slope))
        if steep < 1e-7:
            break
        curve = weight * p * (1 - p)
        step, left = np.zeros_like(w), -slope
        to, size = left.copy(), float(left @ left)
        enough = min(0.1, steep**0.5) ** 2 * size
        for _ in range(200):
            bent = down(curve * up(to)) + (shrink + 1e-9) * to
            by = size / float(to @ bent)
            step, left = step + by * to, left - by * bent
            now = float(left @ left)
            if now < enough:
                break
            to, size = left + now / size * to, now
        far, dz, down_by = 1.0, up(step), float(slope @ step)
        while far > 1e-6 and loss(w + far * step, z + far * dz) > value + 1e-4 * far * down_by:
            far /= 2
        w, z = w + far * step, z + far * dz
        value = loss(w, z)
    return w


def _lift(x: Sparse, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-odds over those of a text without any feature. The base rate, which differs between the folds and would tell
    a held-out row's label, is left out."""
    return np.clip(x.dot(w[: x.width]) + extra @ w[x.width : -1], -12, 12)


def best_threshold(odds: np.ndarray, y: np.ndarray) -> float:
    """Midway between two neighbouring different scores, where rejecting what is above has the best F1; of equal ones the highest."""
    if not y.any() or y.all():
        return float("inf")
    order = np.argsort(-odds, kind="stable")
    score = odds[order]
    f1 = 2 * np.cumsum(y[order]) / (np.arange(1, len(y) + 1) + y.sum())
    next_score = np.append(score[1:], score[-1] - 2)
    at = int(np.argmax(np.where(score > next_score, f1, -1)))
    return float(score[at] + next_score[at]) / 2


class Chain:
    def __init__(self, vocabulary: dict[str, int], weights: list[np.ndarray], threshold: float):
        self.vocabulary, self.weights, self.threshold = vocabulary, weights, threshold
        self._sets: list | None = None

    @classmethod
    def fit(cls, vocabulary: dict[str, int], chosen: np.ndarray, x: Sparse, labels: np.ndarray, fold: np.ndarray) -> Chain:
        """``chosen``: features of the models without fold 0, 1, ... and of the final models, a row each."""
        extra, out, weights = np.zeros((x.n, 0)), np.zeros(x.n), []
        views = [x.only(c) for c in chosen]
        for y in labels.T.astype(float):
            out = np.zeros(x.n)
            for f in range(FOLDS):
                held = fold == f
                if held.any():
                    out[held] = _lift(views[f], extra, fit_linear(views[f], extra, y, (~held).astype(float)))[held]
            weights.append(fit_linear(views[FOLDS], extra, y, np.ones(x.n)))
            extra = np.column_stack([extra, out])
        return cls(vocabulary, weights, max(0.0, best_threshold(out, labels[:, -1].astype(bool))))

    def _found(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, feature) for the features of distinct words, by Arrow: the words themselves, then prefixes by length."""
        if self._sets is None:
            tokens, numbers = list(self.vocabulary), np.array(list(self.vocabulary.values()), np.int64)
            kinds = [(None, [i for i, t in enumerate(tokens) if t[0] != "^"])] + [(n, [i for i, t in enumerate(tokens) if t[0] == "^" and len(t) == n + 1]) for n in PREFIXES]
            self._sets = [(n, pa.array([tokens[i].lstrip("^") for i in at], pa.large_string()), numbers[at]) for n, at in kinds]
        word, feature = [], []
        for n, values, numbers in self._sets:
            got = pc.index_in(distinct if n is None else pc.utf8_slice_codeunits(distinct, 0, n), value_set=values)
            at = np.flatnonzero(pc.is_valid(got).to_numpy(zero_copy_only=False))
            if n is not None and len(at):  # a shorter word is no prefix
                at = at[pc.utf8_length(distinct.take(pa.array(at))).to_numpy() >= n]
            word.append(at)
            feature.append(numbers[got.take(pa.array(at)).to_numpy().astype(np.int64)])
        return np.concatenate(word), np.concatenate(feature)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (rows x categories) and the rejections."""
        distinct, row, word = words(texts)
        owner, feature = self._found(distinct)
        order = np.argsort(owner, kind="stable")
        owner, flat = owner[order], feature[order]
        size = np.bincount(owner, minlength=len(distinct))
        start = np.cumsum(size) - size
        row, word = row[size[word] > 0], word[size[word] > 0]
        each = size[word]
        at = np.arange(int(each.sum())) + np.repeat(start[word] - (np.cumsum(each) - each), each)
        width = max(len(self.vocabulary), 1)
        pair = np.unique(np.repeat(row, each) * width + flat[at])
        x = Sparse(pair // width, pair % width, len(texts), len(self.vocabulary))
        extra = np.zeros((x.n, 0))
        for w in self.weights:
            extra = np.column_stack([extra, _lift(x, extra, w)])
        return _sigmoid(extra + [w[-1] for w in self.weights]), extra[:, -1] > self.threshold

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_sets": None}


# --- training over tables -------------------------------------------------------------------------------------------


def _features(train: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the tokens that a model uses, and which model does. Counts by fold are pre-aggregated before the shuffle;
    a fold's model sees the counts of the other folds."""
    toxic, folds = F.col("toxic") == 1, range(FOLDS)
    by = [F.count_if((F.col("fold") == f) & t).alias(f"{k}{f}") for k, t in (("a", toxic), ("b", ~toxic)) for f in folds]
    totals = train.agg(*by).first()
    counts = train.select("fold", "toxic", F.explode("tokens").alias("token")).groupBy("token").agg(*by)

    def chosen(left_out: int) -> Column:
        used = [f for f in folds if f != left_out]
        n_a, n_b = (sum(totals[f"{k}{f}"] for f in used) for k in "ab")
        a, b = (sum((F.col(f"{k}{f}") for f in used), F.lit(0)) for k in "ab")
        part = lambda v: F.when(v > 0, v * F.ln(v.cast("double"))).otherwise(0.0)
        ratio = part(a) + part(b) + part(n_a - a) + part(n_b - b) - part(a + b) - part(n_a + n_b - a - b) - part(F.lit(n_a)) - part(F.lit(n_b)) + part(F.lit(n_a + n_b))
        return 2 * ratio >= SIGNIFICANT

    marks = F.array(*[chosen(f) for f in range(FOLDS + 1)])
    rows = counts.select("token", marks.alias("m")).where(F.exists("m", lambda m: m)).orderBy("token").collect()
    return {r["token"]: i for i, r in enumerate(rows)}, np.array([r["m"] for r in rows], bool).reshape(-1, FOLDS + 1).T


def train_chain(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", max_train: int = MAX_TRAIN) -> Chain:
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    sample = given.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"))
    sample = sample.orderBy(F.xxhash64(F.lit(6), "id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    rows = rows.groupBy("id", "toxic", "quality").agg(F.min("text").alias("text"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                part = batch.slice(at, len(texts))
                kept = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), token_lists(texts)], names=[*kept, "tokens"])
                at += len(texts)

    fold = F.pmod(F.xxhash64(F.lit(66), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = rows.select(F.col("id").cast("bigint"), F.col("toxic").cast("int"), F.col("quality").cast("int"), fold, "text")
    train = materialize(rows.mapInArrow(tokenised, "id bigint, toxic int, quality int, fold int, tokens array<string>"), "toxicity-train")
    vocabulary, chosen = _features(train)

    known = pa.array(list(vocabulary), pa.string())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            row, got = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), pc.index_in(lists.flatten(), value_set=known)
            at = np.flatnonzero(pc.is_valid(got).to_numpy(zero_copy_only=False))
            x = _lists(row[at], got.take(pa.array(at)), len(lists))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "toxic", "quality", "fold")), x], names=["id", "toxic", "quality", "fold", "x"])

    got = sorted(train.mapInArrow(encoded, "id bigint, toxic int, quality int, fold int, x array<int>").collect(), key=lambda r: r["id"])
    toxic, good = np.array([r["toxic"] == 1 for r in got], bool), np.array([r["quality"] != 0 for r in got], bool)
    x = Sparse(np.repeat(np.arange(len(got)), [len(r["x"]) for r in got]), np.array([c for r in got for c in r["x"]], np.int64), len(got), len(vocabulary))
    return Chain.fit(vocabulary, chosen, x, np.column_stack([toxic & good, toxic & ~good, toxic]).reshape(-1, len(CATEGORIES)), np.array([r["fold"] for r in got], np.int64))


def scores(chain: Chain, text: Column) -> Column:
    """Struct of the category probabilities and ``rejected``."""
    fields = [f"p_{c}" for c in CATEGORIES]

    @F.arrow_udf(", ".join(f"{f} double" for f in fields) + ", rejected boolean")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [chain.predict(part) for part in slices(texts)]
        p = np.concatenate([p for p, _ in parts]) if parts else np.zeros((0, len(fields)))
        rejected = np.concatenate([r for _, r in parts]) if parts else np.zeros(0, bool)
        return pa.StructArray.from_arrays([*(pa.array(p[:, i]) for i in range(len(fields))), pa.array(rejected)], names=[*fields, "rejected"])

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    chain = train_chain(docs, labels, id_col=id_col, text_col=text_col)
    return docs.select(F.col(id_col), scores(chain, F.col(text_col)).alias("s")).select(id_col, "s.*")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents that are not rejected, whole."""
    chain = train_chain(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(~scores(chain, F.col(text_col))["rejected"])
