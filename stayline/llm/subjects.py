"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams of sentences, from weak labels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayline.operators.common import cut_lineage, require, ship_package

#: Most labelled documents, and most weakly labelled ones per source, that a model is fitted to (the first by hash).
MAX_LABELLED = 12_000
MAX_WEAK = 300
#: Longest document that a model is fitted to, in characters. Documents to be judged may be of any length.
MAX_TRAIN_CHARS = 20_000
BITS = 18
#: Most areas; a model has 2^18 weights of each.
MAX_AREAS = 1_000
_WORD = re.compile(r"[^\W\d_]+|\d+")
#: Ends of lines, and of sentences; a German ordinal (`Am 7. Tag`) ends none.
_CUT = re.compile(r"\s*\n\s*|(?<=[.!?;])(?<!\b[Aa]m \d\.)(?<!\b[Aa]m \d\d\.)['\"]?[ \t]+(?=\S)")
#: A key before the text of a line: `'Care Taker 3':`, `FINDINGS:`, a list number.
_KEY = re.compile(r"^\s*(?:[-*>]+\s*)*(?:'[^':]{1,40}':\s*|[A-Z][A-Z /]{2,40}:\s*|\d{1,2}[.)]\s+)?['\"]?")


@dataclass(frozen=True)
class SubjectRules:
    """``rounds`` of relabelling sentences, ``epochs`` of the last and ``warm`` of the earlier ones, ``folds`` of the calibration, ``rate`` of the descent, ``l2`` its shrinkage, ``seed`` its order.
    ``share``: part of a document's sentences that makes an area its own, where labels don't calibrate another; the
    calibrated share stays within ``low`` and ``high``."""

    rounds: int = 4
    epochs: int = 8
    warm: int = 3
    folds: int = 4
    rate: float = 0.5
    l2: float = 1e-6
    seed: int = 7
    share: float = 0.19
    low: float = 0.13
    high: float = 0.24


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence of a text (of each line, in lists and maps); numbers become one word."""
    out = []
    for part in _CUT.split(text):
        w = ["#" if x[0].isdigit() else x for x in _WORD.findall(_KEY.sub("", part, count=1).lower())]
        if any(x != "#" for x in w):
            out.append(w)
    return out


class Hasher:
    """Hashed features of sentences: word unigrams, bigrams and trigrams, in one array with row bounds."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.known: dict[str, int] = {}

    def __call__(self, sents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(feature numbers, start of each sentence); every sentence has at least one word."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        flat: list[int] = []
        for s in sents:
            for w in s:
                h = known.get(w)
                if h is None:
                    h = known[w] = zlib.crc32(w.encode())
                flat.append(h)
        n = np.fromiter((len(s) for s in sents), np.int64, len(sents))
        h = np.array(flat, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        row = np.repeat(np.arange(len(sents)), n)
        grams, rows = [h], [row]
        for k in (1, 2):
            if len(h) > k:
                prev = grams[-1][:-1] if k > 1 else h[:-1]
                g = (prev * np.uint64(0xC2B2AE3D27D4EB4F)) ^ h[k:] ^ np.uint64(k)
                grams.append(g)
                rows.append(np.where(row[:-k] == row[k:], row[:-k], -1))
        g, r = np.concatenate(grams), np.concatenate(rows)
        g, r = g[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        g ^= g >> np.uint64(31)
        feats = ((g * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40) & self.mask).astype(np.int32)[order]
        return feats, np.searchsorted(r[order], np.arange(len(sents))).astype(np.int64)


@dataclass
class SubjectModel:
    areas: list[str]
    weights: np.ndarray  # features + bias row, areas
    share: np.ndarray
    bits: int

    def logits(self, feats: np.ndarray, start: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(start, len(feats)))[:, None]
        out = np.empty((len(start), len(self.areas)), np.float32)
        for a in range(0, len(start), 4096):
            b = min(len(start), a + 4096)
            lo, hi = start[a], start[b] if b < len(start) else len(feats)
            out[a:b] = np.add.reduceat(self.weights[feats[lo:hi]], start[a:b] - lo, axis=0)
        return out / np.sqrt(n) + self.weights[-1]

    def shares(self, texts: list[str], hasher: Hasher) -> np.ndarray:
        """Per text the part of its sentences that deals with each area; zeros for a text without words."""
        sents = [sentences(t or "") for t in texts]
        out = np.zeros((len(texts), len(self.areas)), np.float32)
        size = np.array([len(s) for s in sents])
        if size.sum():
            hit = _assigned(self.logits(*hasher([x for s in sents for x in s])))
            full = np.flatnonzero(size)
            at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
            out[full] = np.add.reduceat(hit.astype(np.float32), at, axis=0) / size[full][:, None]
        return out


def _assigned(logits: np.ndarray) -> np.ndarray:
    """A sentence deals with an area if the area's classifier says so and no other says so much more surely."""
    return (logits > 0) & (logits >= logits.max(axis=1, keepdims=True) - 2.0)


def _descend(feats: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, dim: int, r: SubjectRules, epochs: int) -> np.ndarray:
    """One-versus-rest logistic regression by AdaGrad over mini-batches; the last row of the result is the bias."""
    k = y.shape[1]
    w, g2 = np.zeros((dim + 1, k), np.float32), np.full((dim + 1, k), 1e-2, np.float32)
    rng = np.random.default_rng(r.seed)
    size = np.diff(np.append(start, len(feats)))
    scale = (1 / np.sqrt(size)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(start))
        for a in range(0, len(order), 512):
            rows = order[a : a + 512]
            n = size[rows]
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            f = feats[np.repeat(start[rows] - at, n) + np.arange(n.sum())]
            z = np.add.reduceat(w[f], at, axis=0) * scale[rows][:, None] + w[-1]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows]
            u, inv = np.unique(f, return_inverse=True)
            order_f = np.argsort(inv, kind="stable")
            per = np.repeat(d * scale[rows][:, None], n, axis=0)[order_f]
            grad = np.add.reduceat(per, np.searchsorted(inv[order_f], np.arange(len(u))), axis=0) + r.l2 * w[u]
            g2[u] += grad**2
            w[u] -= r.rate * grad / np.sqrt(g2[u])
            gb = d.sum(axis=0)
            g2[-1] += gb**2
            w[-1] -= r.rate * 0.2 * gb / np.sqrt(g2[-1])
    return w


def _prepare(texts: list[str], labels: list[set[str]], areas: list[str], sure: list[float] | None) -> tuple[list[list[list[str]]], np.ndarray, np.ndarray]:
    """(sentences of each document, its labels as a row of zeros and ones, its weight); documents without words fall out."""
    col = {a: i for i, a in enumerate(areas)}
    docs, y0, conf = [], [], []
    for t, ls, c in zip(texts, labels, sure or [1.0] * len(texts)):
        s = sentences(t or "")
        if s:
            docs.append(s)
            conf.append(c)
            row = np.zeros(len(areas), np.float32)
            row[[col[x] for x in ls if x in col]] = 1
            y0.append(row)
    return docs, np.array(y0, np.float32).reshape(len(docs), len(areas)), np.array(conf, np.float32)


def _learn(docs: list[list[list[str]]], y0: np.ndarray, conf: np.ndarray, areas: list[str], rules: SubjectRules, bits: int) -> SubjectModel:
    """Classifiers of sentences from documents labelled as a whole, with ``rules.share`` as the share of every area.

    Sentences start with their document's labels; each round the classifiers judge them anew: of a labelled area only the
    sentences keep it that the classifier grants it (the best one always), and a document whose sentences mostly speak
    of an area that it isn't labelled with, as with a wrong label, is left out of the next round.
    """
    model = SubjectModel(areas, np.zeros(((1 << bits) + 1, len(areas)), np.float32), np.full(len(areas), rules.share), bits)
    if not docs:
        model.weights -= 1
        return model
    size = np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), size)
    feats, start = Hasher(bits)([s for d in docs for s in d])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    y, weight = y0[doc].copy(), (conf[doc] / np.maximum(1, y0.sum(axis=1))[doc])[:, None] * np.ones((1, len(areas)), np.float32)
    for k in range(rules.rounds):
        model.weights = _descend(feats, start, y, weight, 1 << bits, rules, rules.epochs if k == rules.rounds - 1 else rules.warm)
        if k == rules.rounds - 1:
            break
        z = model.logits(feats, start)
        best = np.maximum.reduceat(z, first, axis=0)[doc]
        grants = (z > 0) | (z >= best - 1e-6)
        y = y0[doc] * (_assigned(z) | ((z >= best - 1e-6) & (k < rules.rounds - 2)) if k else grants)
        said = np.add.reduceat(_assigned(z).astype(np.float32), first, axis=0) / size[:, None]
        odd = ((said * (1 - y0)).max(axis=1) > 0.4) | ((y0.sum(axis=1) > 0) & ((said * y0).max(axis=1) < 0.1) & (k > 0))
        weight = (np.where(odd, 0.0, conf)[doc])[:, None] * np.ones((1, len(areas)), np.float32)
    return model


def _said(model: SubjectModel, docs: list[list[list[str]]]) -> np.ndarray:
    """Per document the part of its sentences that deals with each area."""
    if not docs:
        return np.zeros((0, len(model.areas)), np.float32)
    size = np.array([len(d) for d in docs])
    hit = _assigned(model.logits(*Hasher(model.bits)([s for d in docs for s in d]))).astype(np.float32)
    return np.add.reduceat(hit, np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0) / size[:, None]


def _held_out(docs: list, y0: np.ndarray, conf: np.ndarray, areas: list[str], rules: SubjectRules, bits: int, fold: int) -> np.ndarray:
    """What a model fitted to the other folds says of the documents of one (every ``rules.folds``-th)."""
    out = np.arange(len(docs)) % rules.folds == fold
    model = _learn([d for d, o in zip(docs, out) if not o], y0[~out], conf[~out], areas, rules, bits)
    return _said(model, [d for d, o in zip(docs, out) if o])


def _calibrated(model: SubjectModel, y0: np.ndarray, conf: np.ndarray, held: list[np.ndarray], rules: SubjectRules) -> SubjectModel:
    said = np.zeros_like(y0)
    for f, h in enumerate(held):
        said[np.arange(len(y0)) % rules.folds == f] = h
    if len(y0):
        model.share = _calibrate(said, y0, conf >= 1, rules)
    return model


def fit(texts: list[str], labels: list[set[str]], areas: list[str], sure: list[float] | None = None, rules: SubjectRules = SubjectRules(), bits: int = BITS) -> SubjectModel:
    """Fit to documents labelled as a whole (see :func:`_learn`). ``sure``: weight of each document, 1 by default (less for weak labels).

    Shares are calibrated for the best F1 over the labelled documents as judged by models that were not fitted to them, held near ``rules.share``
    where positives are few.
    """
    docs, y0, conf = _prepare(texts, labels, areas, sure)
    held = [_held_out(docs, y0, conf, areas, rules, bits, f) for f in range(rules.folds)]
    return _calibrated(_learn(docs, y0, conf, areas, rules, bits), y0, conf, held, rules)


def _calibrate(said: np.ndarray, y0: np.ndarray, use: np.ndarray, r: SubjectRules) -> np.ndarray:
    """Per area the share that gives the best F1 on labelled documents, pooled over areas first, then drawn to the pooled one."""
    grid = np.arange(r.low, r.high + 1e-9, 0.005)
    said, y0 = said[use], y0[use]
    if not len(said):
        return np.full(y0.shape[1], r.share)
    hit = said[None] >= grid[:, None, None] - 1e-6
    tp, fp = (hit & (y0[None] > 0)).sum(axis=1), (hit & (y0[None] == 0)).sum(axis=1)
    pos = (y0 > 0).sum(axis=0)
    f1 = lambda t, f, p: 2 * t / np.maximum(1, t + f + p)
    pooled = f1(tp.sum(axis=1), fp.sum(axis=1), pos.sum())
    top = grid[pooled >= pooled.max() - 1e-3].mean()
    out = []
    for a in range(y0.shape[1]):
        own = f1(tp[:, a], fp[:, a], pos[a])
        mine = grid[own >= own.max() - 2e-3].mean()
        out.append((top * 60 + mine * pos[a]) / (60 + pos[a]))
    return np.array(out)


def training_rows(docs: DataFrame, labels: DataFrame, weak: dict[str, str], doc_id: str, text: str, source: str) -> list[tuple[str, set[str], float]]:
    """(text, labels, weight) of at most ``MAX_LABELLED`` labelled and ``MAX_WEAK`` weakly labelled documents per source, whole,
    of at most ``MAX_TRAIN_CHARS`` characters each; the first by hash. The texts are read in one pass."""
    per = labels.dropna().distinct().groupBy("doc_id").agg(F.collect_set("subject_area").alias("areas"))
    per = cut_lineage(per.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    kind = F.lower(F.trim(F.col(source)))
    n = {r.s: r.n for r in docs.select(kind.alias("s")).where(F.col("s").isin(*weak)).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} if weak else {}
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), kind.alias("s")).where(F.length("t") <= MAX_TRAIN_CHARS)
    # of each weak source the low end of the hashes, three times as many as are taken
    place = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    low = F.lit(False)
    for s, c in n.items():
        low = low | ((F.col("s") == s) & (place <= min(1.0, 3 * MAX_WEAK / c + 30 / c)))
    got = base.join(F.broadcast(per), "doc_id", "left").where(F.col("areas").isNotNull() | low).select("doc_id", "t", "s", "areas", F.xxhash64("doc_id").alias("h")).collect()
    got.sort(key=lambda r: (r.h, r.doc_id))
    rows = [(r.t, set(r.areas), 1.0) for r in got if r.areas is not None]
    for s, area in sorted(weak.items()):
        rows += [(r.t, {area}, 0.5) for r in got if r.areas is None and r.s == s][:MAX_WEAK]
    return rows


def train(docs: DataFrame, labels: DataFrame, areas: DataFrame, weak: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", rules: SubjectRules = SubjectRules()) -> SubjectModel:
    """Fit a model from a labelled sample (``doc_id, subject_area``) and, weakly, from the area that a source is mostly about.

    The driver holds the bounded sample only; the bounds are ``MAX_LABELLED``, ``MAX_WEAK`` and ``MAX_TRAIN_CHARS``. The model and those of the folds that
    calibrate it are fitted by tasks of their own; weights, of features x areas floats, and the folds' shares come back.
    """
    require(docs, [doc_id, text, source])
    require(labels, ["doc_id", "subject_area"])
    spark = docs.sparkSession
    names = sorted(r[0] for r in areas.select("subject_area").dropna().distinct().limit(MAX_AREAS + 1).collect())
    if len(names) > MAX_AREAS:
        raise ValueError(f"more than {MAX_AREAS} areas: the weights would outgrow a task")
    rows = training_rows(docs, labels, {k: v for k, v in (weak or {}).items() if v in names}, doc_id, text, source)
    ship_package(spark)
    shared = spark.sparkContext.broadcast(rows)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, sets, sure = zip(*shared.value) if shared.value else ((), (), ())
        made = None
        for b in batches:
            for job in b["id"].tolist():
                made = made or _prepare(list(texts), list(sets), names, list(sure))
                got = _learn(*made, names, rules, BITS).weights if job == rules.folds else _held_out(*made, names, rules, BITS, job)
                yield pd.DataFrame({"job": [job], "rows": [len(got)], "data": [got.astype(np.float32).tobytes()]})

    jobs = spark.range(0, rules.folds + 1, 1, rules.folds + 1).mapInPandas(work, "job long, rows long, data binary").collect()
    parts = {r.job: np.frombuffer(r.data, np.float32).reshape(r.rows, len(names)) for r in jobs}
    shared.unpersist()
    _, y0, conf = _prepare([t for t, _, _ in rows], [ls for _, ls, _ in rows], names, [c for _, _, c in rows])
    model = SubjectModel(names, parts[rules.folds], np.full(len(names), rules.share), BITS)
    return _calibrated(model, y0, conf, [parts[f] for f in range(rules.folds)], rules)


def subject_areas(docs: DataFrame, model: SubjectModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, subject_area, share``: the areas whose share of a document's sentences reaches the calibrated one.

    Documents with null, empty or wordless text, and those about no area, give no rows; repeated documents give theirs again. The
    model is broadcast (features x areas floats, fixed by ``BITS``); every document is read whole; nothing is shuffled.
    """
    require(docs, [doc_id, text])
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hasher = shared.value, Hasher(shared.value.bits)
        for pdf in batches:
            for a in range(0, len(pdf), 500):
                part = pdf.iloc[a : a + 500]
                s = m.shares(part["t"].tolist(), hasher)
                i, j = np.nonzero((s >= m.share - 1e-6) & (s > 0))
                yield pd.DataFrame({"doc_id": part["d"].to_numpy()[i], "subject_area": np.array(m.areas, dtype=object)[j], "share": s[i, j].astype("float64")})

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(judge, f"doc_id {kind}, subject_area string, share double")
