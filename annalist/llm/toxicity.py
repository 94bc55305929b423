"""Toxicity from the nearest labelled examples by exact TF-IDF cosine (operator 3)."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annalist.llm.tables import clean_names, map_rows, pieces, typed, words

#: Labelled rows of each class that the examples are taken from, by hash of their ids.
SAMPLE_ROWS = 5000
#: Most terms of the vocabulary, the least likelihood ratio that ties a term to the label, and how many
#: times as common it must be under label 1.
TERMS, LIKELIHOOD, TIMES = 512, 20.0, 3.0
#: Lengths, in bytes, of the word beginnings that are terms too, so that inflected words are met.
BEGINNINGS = (4, 5, 6)
NEIGHBOURS = 15
#: Examples of a block of the index.
BLOCK = 256


def spelled(text: str | None) -> list[bytes]:
    """Words in lower case, of all scripts."""
    return words(text.lower()) if text else []


def terms(own: set[bytes]) -> set[bytes]:
    """The terms of a set of words: the words, and their beginnings marked by a trailing ``*``."""
    out = set(own)
    for n in BEGINNINGS:
        out |= {w[:n] + b"*" for w in own if len(w) > n}
    return out


def _begun(own: set[bytes], starts: frozenset[bytes]) -> list[tuple[bytes, bytes]]:
    """(word, term) for every known beginning of the words."""
    least = BEGINNINGS[0]
    heads = {s[:least] for s in starts}
    some = [w for w in own if w[:least] in heads]
    return [(w, w[:n] + b"*") for w in some for n in BEGINNINGS if len(w) > n and w[:n] in starts]


def vector(own: list[bytes], known: dict[bytes, int], starts: frozenset[bytes]) -> dict[int, int]:
    """How often each known term occurs in the words; if one does, also the number of all words, under the last id."""
    distinct = set(own)
    found = {known[w]: own.count(w) for w in distinct & known.keys()}
    for w, term in _begun(distinct, starts):
        if (k := known.get(term)) is not None:
            found[k] = found.get(k, 0) + own.count(w)
    if found:
        found[len(known)] = len(own)
    return found


class BlockMaxIndex:
    """Unit vectors of the examples as an inverted index in blocks, with each term's largest weight in every block."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(rows)
        blocks = -(-self.n // BLOCK)
        self.most = np.zeros((n_terms, max(1, blocks)))
        inverted: dict[int, tuple[list[int], list[float]]] = defaultdict(lambda: ([], []))
        for i, (ks, ws) in enumerate(rows):
            for k, w in zip(ks.tolist(), ws.tolist()):
                inverted[k][0].append(i)
                inverted[k][1].append(w)
                self.most[k, i // BLOCK] = max(self.most[k, i // BLOCK], w)
        self.ids, self.weights, self.starts = {}, {}, {}
        for k, (ids, ws) in inverted.items():
            self.ids[k], self.weights[k] = np.array(ids), np.array(ws)
            self.starts[k] = np.searchsorted(self.ids[k], np.arange(blocks + 1) * BLOCK)

    def nearest(self, ks: np.ndarray, ws: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine over 0, exactly, best first and by place on ties.

        Blocks are read by falling upper bound and skipped once it is below the k-th cosine.
        """
        bounds = ws @ self.most[ks]
        best_ids, best = np.empty(0, np.int64), np.empty(0)
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or len(best) == k and bounds[b] < best[-1] - 1e-12:
                break
            part = np.zeros(BLOCK)
            for t, w in zip(ks.tolist(), ws.tolist()):
                if t in self.ids:
                    lo, hi = self.starts[t][b], self.starts[t][b + 1]
                    part[self.ids[t][lo:hi] - b * BLOCK] += w * self.weights[t][lo:hi]
            if 0 <= but - b * BLOCK < BLOCK:
                part[but - b * BLOCK] = 0
            some = np.flatnonzero(part > 0)
            ids, cos = np.r_[best_ids, some + b * BLOCK], np.r_[best, part[some]]
            order = np.lexsort((ids, -np.round(cos, 12)))[:k]
            best_ids, best = ids[order], cos[order]
        return best_ids, best


@dataclass
class Model:
    """What scoring needs: bounded by the sample of labelled rows and the vocabulary."""

    known: dict[bytes, int]
    idf: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    examples: list[int]
    without: float
    curve: tuple[float, float]
    starts: frozenset[bytes]

    def unit(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of TF-IDF weights; all words together are one coordinate, so that texts are
        near each other if they hold the same terms as densely."""
        ks = np.array(sorted(found), dtype=np.int64)
        ws = np.array([math.sqrt(found[k]) if k == len(self.known) else (1 + math.log(found[k])) * self.idf[k] for k in ks.tolist()])
        return ks, ws / (np.linalg.norm(ws) or 1.0)

    def votes(self, ks: np.ndarray, ws: np.ndarray, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Votes weighted by nearness, one vote of 0.5 held against the neighbours."""
        ids, cos = self.index.nearest(ks, ws, NEIGHBOURS, but)
        return float((cos @ self.labels[ids] + 0.25) / (cos.sum() + 0.5)), ids, cos

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Probability of label 1, and the examples that voted (id, cosine, label)."""
        found = vector(spelled(text), self.known, self.starts)
        if not found:
            return self.without, []
        vote, ids, cos = self.votes(*self.unit(found))
        a, b = self.curve
        return _logistic(a * vote + b), [(self.examples[i], float(c), int(self.labels[i])) for i, c in zip(ids.tolist(), cos.tolist())]


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-min(max(x, -500), 500)))


def _fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from votes to probabilities, with a light ridge; Newton steps."""
    x = np.c_[votes, np.ones(len(votes))]
    beta = np.array([8.0, -4.0])
    start = beta.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weights * (labels - p)) - 0.1 * (beta - start)
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.1, float(beta[0])), float(beta[1])


def _ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a term in ``a`` of ``n1`` and ``b`` of ``n0`` rows; 0 unless it speaks for label 1."""
    if not a or a * n0 <= b * n1:
        return 0.0
    share = (a + b) / (n1 + n0)
    cells = ((a, n1 * share), (b, n0 * share), (n1 - a, n1 * (1 - share)), (n0 - b, n0 * (1 - share)))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o)


def _counted(rows: DataFrame, of: Callable[[str | None], set[bytes]]) -> DataFrame:
    """(term, label, n): rows of each label that hold a term, summed in tasks and then by Spark; the empty term counts rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                total: Counter[tuple[bytes, int]] = Counter()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    total.update((t, label) for t in of(text))
                    total[b"", label] += 1
                yield pa.RecordBatch.from_pydict({"term": pa.array([k[0] for k in total], pa.binary()), "label": pa.array([k[1] for k in total], pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    return rows.mapInArrow(run, "term binary, label int, n long").groupBy("term", "label").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_ROWS) -> Model:
    """Examples, vocabulary and calibration from labelled rows, term counts from all documents.

    Of ``labels`` (key, label) the ``sample`` rows of each class that come first by hash of
    their key are joined to their texts; null keys and labels are left out. Terms are those
    that are far more common under label 1, by their likelihood ratio. Their document frequencies are counted over
    all of ``docs``. Examples without any such term are no neighbours of anything; their
    share of label 1 is the score of documents without terms. Votes of each example by the
    others give the calibration curve, weighted to the classes' sizes in all labels.
    """
    given = labels.select(F.col(f"`{key}`").alias("k"), (F.col(f"`{label}`") > 0).cast("int").alias("y")).filter("k is not null and y is not null")
    sizes = {r[0]: r[1] for r in given.groupBy("y").count().collect()}
    n1, n0 = (min(sample, sizes.get(y, 0)) for y in (1, 0))
    chosen = [given.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (1, 0)]
    ids = {y: sorted({r[0] for r in c.collect()}) for y, c in zip((1, 0), chosen)}
    spark = docs.sparkSession
    small = spark.createDataFrame([(k, y) for y in (1, 0) for k in ids[y]], "k long, y int")
    examples = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(small), "k")

    counts: dict[bytes, dict[int, int]] = defaultdict(dict)
    totals = _counted(examples.select("t", "y"), lambda t: terms(set(spelled(t))))
    pivot = totals.groupBy("term").agg(*[F.sum(F.when(F.col("label") == y, F.col("n")).otherwise(0)).alias(f"n{y}") for y in (1, 0)])
    at = pivot.filter("octet_length(term) = 0").first()
    n1, n0 = (at[1], at[2]) if at else (0, 0)
    known: dict[bytes, int] = {}
    if n1 and n0:
        for r in pivot.filter("octet_length(term) > 0 and n1 >= 2").filter(F.col("n1") / n1 >= TIMES * (F.col("n0") + 0.5) / n0).orderBy(F.desc(F.col("n1") / n1 - F.col("n0") / n0), "term").limit(8 * TERMS).collect():
            counts[bytes(r[0])] = {1: r[1], 0: r[2]}
        ranked = sorted(((-_ratio(c[1], c[0], n1, n0), t) for t, c in counts.items()))
        known = {t: i for i, (g, t) in enumerate(x for x in ranked[:TERMS] if -x[0] >= LIKELIHOOD)}

    starts = frozenset(t[:-1] for t in known if t.endswith(b"*"))
    lookup = frozenset(known)
    total = docs.count() if not known else 0
    df = np.zeros(len(known) + 1)
    if known:
        pairs = _counted(docs.select(F.col(f"`{text}`").alias("t"), F.lit(0).alias("y")), lambda t: _held(t, lookup, starts)).select("term", "n").collect()
        for t, n in pairs:
            if bytes(t):
                df[known[bytes(t)]] = n
            else:
                total = n
    idf = np.log((1 + total) / (1 + df[: len(known)])) + 1e-9

    def vectors(b: pa.RecordBatch) -> dict:
        found = [vector(spelled(t), known, starts) for t in b.column(1).to_pylist()]
        return {"k": b.column(0), "y": b.column(2), "ks": pa.array([list(f) for f in found], pa.list_(pa.int64())), "cs": pa.array([list(f.values()) for f in found], pa.list_(pa.int64()))}

    rows = map_rows(examples.select("k", "t", "y"), lambda: vectors, "k long, y int, ks array<long>, cs array<long>").collect() if known else []
    # examples that share their heaviest term, and hold terms as densely, lie together: blocks differ and bounds are tight
    model = Model(known, idf, BlockMaxIndex([], 1), np.zeros(0), [], 0.0, (8.0, -4.0), starts)
    held = [(model.unit(dict(zip(r["ks"], r["cs"]))), r["y"], r["k"]) for r in rows if r["ks"]]
    held.sort(key=lambda x: (int(x[0][0][int(np.argmax(x[0][1][:-1]))]), float(x[0][1][-1]), x[2]))
    model.index = BlockMaxIndex([x[0] for x in held], len(known) + 1)
    model.labels = np.array([x[1] for x in held], dtype=float)
    model.examples = [x[2] for x in held]
    scale = {y: sizes.get(y, 0) / max(1, n) for y, n in ((1, n1), (0, n0))}
    bare = {y: sum(1 for r in rows if not r["ks"] and r["y"] == y) for y in (1, 0)} if known else {1: n1, 0: n0}
    heavy = bare[1] * scale[1]
    model.without = (heavy + 1e-3) / (heavy + bare[0] * scale[0] + 1)
    if held:
        votes = np.array([model.votes(*x[0], but=i)[0] for i, x in enumerate(held)])
        model.curve = _fit_curve(votes, model.labels, np.where(model.labels > 0, scale[1], scale[0]))
    return model


def _held(text: str | None, lookup: frozenset[bytes], starts: frozenset[bytes]) -> set[bytes]:
    own = set(spelled(text))
    return own & lookup | {t for _, t in _begun(own, starts)} & lookup


EVIDENCE = "array<struct<doc_id:long,cosine:double,label:int>>"


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep`` (``doc_id`` unless given), score, evidence: probability of toxicity of each whole text and the examples that voted.

    Null and empty texts, and texts without any term, get the share of toxic examples
    without terms and no evidence. Equal texts get equal scores; an empty table no rows.
    The model is bounded by its parameters and is sent to the executors.
    """
    keep = [c for c in keep or ["doc_id"] if c not in ("score", "evidence")]
    rows = clean_names(docs, *dict.fromkeys([*keep, text]))
    at = rows.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[pa.RecordBatch], dict]:
        m = sent.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

        def of(b: pa.RecordBatch) -> dict:
            got = [m.score(t) for t in b.column(at).to_pylist()]
            return {c: b.column(i) for i, c in enumerate(keep)} | {
                "score": pa.array([g[0] for g in got], pa.float64()),
                "evidence": pa.array([[dict(zip(("doc_id", "cosine", "label"), e)) for e in g[1]] for g in got], kind),
            }

        return of

    return map_rows(rows, make, f"{typed(rows, keep)}, score double, evidence {EVIDENCE}")


def learnable(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: the rest of the CRC-32 of the id by 5 is not 0."""
    return labels.filter(F.crc32(F.col(f"`{key}`").cast("string")) % 5 != 0)
