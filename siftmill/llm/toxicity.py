"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is fitted in numpy to confirmed toxic texts (P) and unlabelled texts (U).  Its
inputs are the presence of hashed words and word beginnings, of those that are significantly more
frequent in P than in U.  With the class prior p, the risk is

    p * E_P[loss(+1)] + max(0, E_U[loss(-1)] - p * E_P[loss(-1)])

and a minibatch whose bracket is negative takes a step that raises it instead, so the fit cannot
drive the risk of the negatives below zero.  Known clean texts are used for the prior alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: Bounds of the sample of labelled rows that a fit takes: toxic ones, and any, whose labels are then not looked at.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
BITS = 22
#: Words that a worker remembers the weight of.
REMEMBERED = 500_000
_WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Hashed: the word, its beginnings of 3 to 6 letters."""
    n, out = len(word), [f"={word}"]
    out += [f"<{word[:k]}" for k in (3, 4, 5, 6) if n > k]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in out]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def present(text: str) -> np.ndarray:
    """The features that a text has, each once."""
    return np.unique(np.array([f for w in words(text) for f in features(w)], np.int32))


def _digest(row: np.ndarray) -> bytes:
    return hashlib.blake2b(row.tobytes(), digest_size=16).digest()


class NonNegativePU:
    """Logistic loss, Adam, decoupled weight decay."""

    #: An input must be this many standard errors, and this many times, more frequent in P than in U, and in this many texts of P.
    #: These, SLACK, the features, epochs, rate and decay were compared by three-fold cross-validation inside the training fold alone, by the mean F1
    #: at the cut over three tables; settings within 0.005 of the best count as equal.  Words and beginnings of 3 letters and more reach 0.900 with
    #: 40 or 80 epochs and 0.898 with 160, words alone 0.897, beginnings of 4 and more 0.899, beginnings alone 0.876; 160 is kept of the equal ones,
    #: for a small sample has one step an epoch and the corrected risk must settle in them.
    ERRORS, TIMES, LEAST = 3.0, 3.0, 4
    #: How far below zero a minibatch's risk of the negatives may be by chance.
    SLACK = 0.02

    def __init__(self, prior: float, epochs: int = 160, batch: int = 2048, rate: float = 0.03, decay: float = 1e-3, seed: int = 5):
        self.prior, self.epochs, self.batch, self.rate, self.decay, self.seed = prior, epochs, batch, rate, decay, seed
        self.weights, self.bias = {}, float(np.log(prior / (1 - prior)))

    def least(self, n_p: int) -> float:
        """In how many of n_p toxic texts an input must be."""
        return max(self.LEAST, n_p / 200)

    def screened(self, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
        """Which inputs tell P and U apart, by the numbers of texts that have them."""
        share_p, share_u, share = in_p / n_p, in_u / n_u, (in_p + in_u) / (n_p + n_u)
        error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_p + 1 / n_u))
        return (in_p >= self.least(n_p)) & (share_p >= self.TIMES * share_u) & (share_p - share_u >= self.ERRORS * error)

    def fit(self, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> "NonNegativePU":
        """Rows are arrays of features.  Without a positive or an unlabelled row, or without an input that tells them apart, there is no model: every score is 0."""
        # Copies say no more than one text does.
        positive, unlabelled = (list({_digest(x): x for x in rows}.values()) for rows in (positive, unlabelled))
        if not positive or not unlabelled:
            return self
        in_p, in_u = (np.bincount(np.concatenate(rows), minlength=1 << BITS) for rows in (positive, unlabelled))
        kept = np.flatnonzero(self.screened(in_p, in_u, len(positive), len(unlabelled)))
        return self.trained(kept, *([x[np.isin(x, kept)] for x in rows] for rows in (positive, unlabelled)))

    def trained(self, kept: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> "NonNegativePU":
        """Minimises the risk over rows that have no other inputs than those kept."""
        if not len(kept) or not positive or not unlabelled:
            return self
        number = np.full(1 << BITS, -1, np.int32)
        number[kept] = np.arange(len(kept))
        data = [number[f] for f in positive + unlabelled]
        w, b, rng = np.zeros(len(kept)), self.bias, np.random.default_rng(self.seed)
        m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
        n_p, n_u = len(positive), len(unlabelled)
        for _ in range(self.epochs):
            order_p, order_u = rng.permutation(n_p), rng.permutation(n_u)
            steps = max(1, n_u // self.batch)
            for s in range(steps):
                p = order_p[s * n_p // steps : max(s * n_p // steps + 1, (s + 1) * n_p // steps)]
                u = order_u[s * n_u // steps : (s + 1) * n_u // steps] + n_p
                which = [data[i] for i in (*p, *u)]
                rows_of = np.repeat(np.arange(len(which)), [len(k) for k in which])
                k = np.concatenate(which)
                z = np.bincount(rows_of, w[k], minlength=len(which)) + b
                up, uu = slice(0, len(p)), slice(len(p), None)
                g = self.slope(z[up], z[uu])
                gw, gb, t = np.bincount(k, g[rows_of], minlength=len(kept)), g.sum(), t + 1
                m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
                mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
                step = self.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                w = w - step * m / (np.sqrt(v) + 1e-8) - self.rate * self.decay * w
                b -= step * mb / (np.sqrt(vb) + 1e-8)
        self.weights = dict(zip(kept.tolist(), w.tolist()))
        self.bias = float(b)
        return self

    def negative_risk(self, z_p: np.ndarray, z_u: np.ndarray) -> float:
        """The bracket of the risk, from the margins of P and U."""
        return float(np.mean(np.logaddexp(0, z_u)) - self.prior * np.mean(np.logaddexp(0, z_p)))

    def slope(self, z_p: np.ndarray, z_u: np.ndarray) -> np.ndarray:
        """The step's gradient by margin: of the risk, or, where the bracket is negative, of its opposite, which raises it."""
        p, u = 1 / (1 + np.exp(-np.clip(z_p, -40, 40))), 1 / (1 + np.exp(-np.clip(z_u, -40, 40)))
        bracket = np.concatenate([-self.prior * p / len(p), u / len(u)])
        if self.negative_risk(z_p, z_u) < -self.SLACK:
            return -bracket
        return bracket + np.concatenate([self.prior * (p - 1) / len(p), np.zeros(len(u))])

    def scores(self, texts: list[str], known: dict[str, tuple]) -> list[float]:
        """known: the inputs among the features of words met before; most words have none."""
        if len(known) > REMEMBERED:
            known.clear()
        out, weights = [], self.weights
        if not weights:  # the prior says nothing about a text
            return [0.0] * len(texts)
        for text in texts:
            found = set()
            for w in words(text):
                x = known.get(w)
                if x is None:
                    x = known[w] = tuple(f for f in features(w) if f in weights)
                if x:
                    found.update(x)
            z = self.bias + sum(weights[f] for f in sorted(found))
            out.append(float(1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))))
        return out


def in_fold(doc_id: Column) -> Column:
    """Whether a row's label is held out: crc32 of its doc_id as text, modulo 4, is 2.  A null id is not."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def _present(batches):
    for batch in base.slabs(batches):
        rows = [present(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([_digest(x) for x in rows], pa.binary()), pa.array([x.tolist() for x in rows], pa.list_(pa.int32()))], names=["toxic", "digest", "f"])


def _counted(among: np.ndarray | None):
    """In how many of a task's rows a feature is: of all features, or of those among."""

    def run(batches):
        n = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("f").flatten().to_numpy(), minlength=1 << BITS)
        some = np.flatnonzero(n) if among is None else among[n[among] > 0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some])], names=["f", "n"])

    return run


def _restricted(kept: np.ndarray):
    def run(batches):
        for batch in batches:
            own = [np.intersect1d(x, kept).tolist() for x in batch.column("f").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["toxic", "f"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> NonNegativePU:
    """Fits on a bounded sample of the training fold's labelled rows: at most max_positive toxic texts, and as unlabelled ones at most max_unlabelled of any label.

    Samples are the rows with the smallest hashes of doc_id, so they don't depend on partitions; of
    texts with the same words one counts, and if an id has many rows the bounds hold for their
    different texts, those with the smallest digests.  Features are counted where the texts are; the driver gets those frequent
    in P, and of each text those that tell P and U apart.  The prior is the share of toxic rows among
    the training fold's labels (0.1 if there is none), kept within 0.01 and 0.5.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"))).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = own.agg(F.count("*"), F.sum("toxic")).first()
    model = NonNegativePU(min(0.5, max(0.01, (toxic or 0) / n)) if n else 0.1)
    draw = F.xxhash64(F.col("doc_id"))
    known = own.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen_p = known.where("toxic = 1").select("doc_id", F.lit(1).alias("toxic")).orderBy(draw, "doc_id").limit(max_positive)
    chosen_u = known.orderBy(draw, "doc_id").limit(max_unlabelled).select("doc_id", F.lit(0).alias("toxic"))
    chosen = chosen_p.distinct().unionByName(chosen_u.distinct())  # at most max_positive + max_unlabelled ids: small enough to broadcast
    texts = docs.select("doc_id", base.text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    found, _ = base.written(texts.mapInArrow(_present, base.schema(("toxic", "int"), ("digest", "binary"), ("f", "array<int>"))), "toxic-features")
    one = found.dropDuplicates(["toxic", "digest"])
    kept = [found.where(F.col("toxic") == mark).select("toxic", "digest").distinct().orderBy("digest").limit(most) for mark, most in ((1, max_positive), (0, max_unlabelled))]
    kept, _ = base.written(kept[0].unionByName(kept[1]), "toxic-kept")  # no more than the bounds: small enough to broadcast
    rows, _ = base.written(one.join(F.broadcast(kept), ["toxic", "digest"], "left_semi").select("toxic", "f"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    if not n_p or not n_u:
        return model

    def counts(mark: int, among: np.ndarray | None):
        return rows.where(F.col("toxic") == mark).mapInArrow(_counted(among), base.schema(("f", "int"), ("n", "bigint"))).groupBy("f").agg(F.sum("n").alias("n"))

    in_p = counts(1, None).where(F.col("n") >= model.least(n_p)).toArrow()  # at most 200 times the features of a mean text
    some = in_p["f"].to_numpy()
    in_u = dict(zip(*(c.to_pylist() for c in counts(0, some).toArrow().columns))) if len(some) else {}
    kept = np.sort(some[model.screened(in_p["n"].to_numpy(), np.array([in_u.get(f, 0) for f in some.tolist()], np.int64), n_p, n_u)])
    data = rows.mapInArrow(_restricted(kept), base.schema(("toxic", "int"), ("f", "array<int>"))).toArrow()
    marks, own = data["toxic"].to_pylist(), [np.asarray(f, np.int64) for f in data["f"].to_pylist()]
    order = sorted(range(len(marks)), key=lambda i: own[i].tobytes())  # any order of partitions gives one fit
    return model.trained(kept, [own[i] for i in order if marks[i] == 1], [own[i] for i in order if marks[i] == 0])


def _scored(model: NonNegativePU):
    def run(batches):
        known: dict[str, tuple] = {}
        for batch in base.slabs(batches):
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.scores(batch.column("text").to_pylist(), known), pa.float64())], names=["row", "score"])

    return run


def _with_scores(docs: DataFrame, columns: list[str], model: NonNegativePU) -> DataFrame:
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), base.text_of(docs).alias("text"))
    out = base.schema(("score", "double"))
    return rows.mapInArrow(_scored(model), type(out)([rows.schema["row"], *out.fields]))


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.3, model: NonNegativePU | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    A text's score is a function of its words alone; null and empty texts have the score of no word.
    If no word tells toxic texts apart (no or few labels, or a third or more toxic among the unlabelled
    ones), every score is 0, so that no row is predicted, whatever the prior.  A null doc_id is never held out.
    """
    model = model or fitted(docs, labels)
    rows = _with_scores(docs, ["doc_id"], model)
    return rows.select(F.col("row.doc_id").alias("doc_id"), in_fold(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score under cut: all of them if no model could be fitted.

    Rows are mapped one by one: null, empty and very long texts, equal rows and ids are scored like
    any other, a row without words by the model's bias; an empty table gives none.
    """
    return _with_scores(docs, docs.columns, fitted(docs, labels)).where(F.col("score") < cut).select("row.*")
