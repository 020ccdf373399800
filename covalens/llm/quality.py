"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Kiryo and others (2017): with class prior p, the risk is
p R_p(+) + max(0, R_u(-) - p R_p(-)), where R_p averages over trusted positives and
R_u over unlabelled text. The classifier is linear over square roots of a text's
character-class trigram shares and a few measures of repetition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covalens.llm import common

_TRIGRAMS = 512
DENSE = 6
WIDTH = _TRIGRAMS + DENSE


def _classes() -> np.ndarray:
    """Eight kinds of byte: lower, upper, digit, blank, line end or control, punctuation, other sign, beyond ASCII."""
    table = np.full(256, 6, np.uint16)
    for kind, members in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), range(32), b".,;:?'\"-()", (), range(128, 256))):
        table[list(members)] = kind
    return table


_KIND = _classes()


def _dense(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * DENSE
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [len(set(words)) / n, (pairs + 1) / n, len(set(lines)) / len(lines), min(len(text) / n / 20, 2.0), np.log1p(n) / 10, np.log1p(n / len(lines)) / 5]


def features(texts: pa.Array) -> np.ndarray:
    """One row of WIDTH numbers for each text; null is empty."""
    data, offsets = common.flat(texts)
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    for i in range(n):
        body = data[offsets[i] : offsets[i + 1]]
        hist = np.zeros(_TRIGRAMS)
        for at in range(0, max(len(body) - 2, 0), 1 << 20):
            kind = _KIND[body[at : at + (1 << 20) + 2]]
            hist += np.bincount((kind[:-2] << 6) | (kind[1:-1] << 3) | kind[2:], minlength=_TRIGRAMS)
        out[i, :_TRIGRAMS] = np.sqrt(hist / max(hist.sum(), 1))
        out[i, _TRIGRAMS:] = _dense(body.tobytes())
    return out


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative unbiased logistic risk by full-batch Adam.

    Where the negative part of the risk falls below 0 a step only undoes that part.
    """
    x = np.empty((len(positive) + len(unlabelled), positive.shape[1] + 1), np.float32)  # the only copy: the driver has little room
    x[: len(positive), :-1], x[len(positive) :, :-1], x[:, -1] = positive, unlabelled, 1
    mean, sd = x[:, :-1].mean(axis=0, dtype=np.float64), x[:, :-1].std(axis=0, dtype=np.float64) + 1e-3
    x[:, :-1] -= mean.astype(np.float32)
    x[:, :-1] /= sd.astype(np.float32)
    p, u = x[: len(positive)], x[len(positive) :]
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        zp, zu = (y @ w.astype(np.float32) for y in (p, u))
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = (u.T @ su / len(u) - prior * (p.T @ sp) / len(p)).astype(np.float64)
        g = prior * (p.T @ (sp - 1)) / len(p) + g_neg if negative >= 0 else -g_neg
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    own = w[:-1] / sd
    return np.append(own, w[-1] - mean @ own)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: int = 40, recall: float = 0.3) -> float:
    """The share of positives among the unlabelled, of positive and unlabelled features alone.

    For any set S, U(S) >= prior x P(S), so the least ratio of U(S) to P(S) bounds
    the prior, and meets it where S holds positives only. S are the texts above a
    score that the other half of the data has taught, at thresholds that keep
    ``recall`` of the positives at least. 0.5 with fewer than ``least`` texts of a kind.
    """
    if min(len(positive), len(unlabelled)) < least:
        return 0.5
    found = []
    for half in (0, 1):
        w = fit_nnpu(positive[half::2], unlabelled[half::2], 0.5, steps=200)
        p, u = (np.sort(x[1 - half :: 2] @ w[:-1].astype(np.float32)) for x in (positive, unlabelled))
        at = np.quantile(p, np.linspace(0, 1 - recall, 41))
        above = lambda x: len(x) - np.searchsorted(x, at)  # noqa: E731, B023
        # an upper bound of U(S) by a standard error, so that small sets don't win by chance
        share = above(u) / len(u)
        found.append(((share + np.sqrt(share * (1 - share) / len(u))) / (above(p) / len(p))).min())
    return float(np.clip(np.mean(found), 0.01, 0.99))


def held_out(doc_id, modulus: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = 8000) -> tuple[np.ndarray | None, float]:
    """Weights and class prior, from labels whose crc32(doc_id) mod 5 is not 0.

    At most ``bound`` positives and ``bound`` unlabelled documents of those
    remainders are used, those with the least hashes of doc_id, of rows that
    repeat a doc_id the one with the least text; the class prior is estimated
    from these. A document labelled twice counts as positive if any label is;
    negative labels teach nothing. Without positives there are no weights, and
    the prior is 0, or 0.5 if there are no labels.
    """
    mine = held_out(F.col("doc_id"), 5) != 0
    labels = labels.where(F.col(column).isNotNull() & mine).groupBy("doc_id").agg(F.max(column).alias("y"))
    total, ones = labels.agg(F.count("*"), F.sum((F.col("y") == 1).cast("int"))).first()
    if not ones:
        return None, 0.0 if total else 0.5
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = labels.where("y = 1").select("doc_id", F.lit(1).alias("pos")).orderBy(order, "doc_id").limit(bound)
    others = docs.where(mine).select("doc_id", F.lit(0).alias("pos")).distinct().orderBy(order, "doc_id").limit(bound)
    picked = F.broadcast(chosen.unionByName(others))  # two times the bound at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "pos").agg(F.min("text").alias("text")).select("pos", "text")  # one of the rows that repeat a doc_id

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                x = features(batch.column("text")[at : at + 256])
                yield pa.record_batch({"pos": batch.column("pos")[at : at + 256], "x": common.binaries(list(x))})

    got = rows.mapInArrow(run, "pos int, x binary").toArrow()
    body, _ = common.flat(got.column("x"))
    x = body.view(np.float32).reshape(-1, WIDTH)
    pos = got.column("pos").to_numpy() == 1
    if not pos.any():
        return None, 0.5
    other = x[~pos] if (~pos).any() else x
    prior = estimated_prior(x[pos], other)
    return fit_nnpu(x[pos], other, prior), prior


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; predicted is 1 from ``threshold`` on.

    Only the text is an input of a score. Null and empty texts are scored as
    texts without features. held_out is whether crc32(doc_id as text) mod 5 is
    0 (null for a null doc_id, which trains nothing). Other columns are ignored.
    An empty table gives no rows; without positive labels every score is the prior.
    """
    weights, prior = train(docs, labels, bound=bound)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                text = batch.column("text")[at : at + 256]
                z = features(text) @ weights[:-1] + weights[-1] if weights is not None else np.zeros(len(text))
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if weights is not None else np.full(len(text), prior)
                yield pa.record_batch({"doc_id": batch.column("doc_id")[at : at + 256], "held_out": batch.column("held_out")[at : at + 256], "score": pa.array(score, pa.float64()), "predicted": pa.array((score >= threshold).astype(np.int32))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (held_out(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 8000) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose score reaches ``threshold``."""
    weights, prior = train(docs, labels, bound=bound)
    if weights is None:
        return docs if prior >= threshold else docs.limit(0)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, min(256, batch.num_rows - at))
                text = part.column(names.index("text"))
                z = features(text) @ weights[:-1] + weights[-1]
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= threshold))

    return docs.mapInArrow(run, schema)
