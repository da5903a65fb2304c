"""Problem 10: the subject areas of each document.

Complement naive Bayes over the words of sentences. It is trained from the
labelled documents, refined by expectation-maximization over the sentences of
all documents, and gives each sentence one subject or none. A document's share
of sentences on a subject is calibrated by a logistic fit on the labelled
documents, for each subject on its own, so a document may have none or several.

Words are hashed into a fixed number of buckets, so the model has the same size
whatever the corpus; it goes to the tasks with their code. The words of the
texts are hashed once and kept in the shared checkpoint folder for the passes.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.corpus import settled, unique
from leafmill.session import written

#: Buckets of the hashed vocabulary.
BUCKETS = 1 << 17
#: Labelled documents that the classifier is fitted on, at most, drawn by a hash of doc_id.
MAX_LABELLED = 50_000
#: Passes of expectation-maximization over all documents.
ROUNDS = 3
#: Smoothing of the counts, and occurrences below which a bucket says nothing: among the labelled documents, and later.
ALPHA = 1.0
MIN_LABELLED = 3
MIN_COUNT = 8
#: A word says something only if one subject has so much of its occurrences.
CONCENTRATION = 0.4
#: A sentence deals with a subject if its score leads the next by so much.
LEAD = 1.0
#: Posteriors up to this count as none.
SLIGHT = 0.02
#: Sentences that a document is taken to have on every subject, in the refinement.
DOCUMENT_PRIOR = 0.1
#: A subject is about a third of the sentences; the calibration starts from here.
SHARE = 1 / 3
#: Share of the labels that are taken to be wrong.
MISLABELLED = 0.03
#: Words of a sentence, at least.
MIN_WORDS = 4

#: Documents that are worked on at once: what they need stays in the processor's cache.
AT_ONCE = 400
#: Counts that are held before they are added up.
HELD = 2_000_000

_FRONT = re.compile(r"\A\s*---\n.*?\n---\n", re.S)
_CODE = re.compile(r"^```.*?^```[^\n]*$", re.S | re.M)
_LINK = re.compile(r"https?://\S+")
_BREAK = re.compile(r"\n(?:\s*\n\s*|(?=\s*(?:[-*•–—+#>|]|\d+[.)]\s)))|[.!?…][\"”’»)]*\s+|[。！？][\"”’»)]*\s*")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[list[str]]:
    """The words, in lower case, of each readable sentence: no front matter, code, headings or tables."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "---" in text:
        text = _FRONT.sub("", text)
    if "```" in text:
        text = _CODE.sub("\n\n", text)
    if "://" in text:
        text = _LINK.sub(" ", text)
    out = []
    for part in _BREAK.split(text.lower()):
        if len(words := _WORD.findall(part)) >= MIN_WORDS and part.lstrip()[0] not in "#|":
            out.append(words)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket: dict[str, int] = {}

    def rows() -> Iterator[tuple]:
        for doc, text in unique(batches, "doc_id", "text"):
            words: list[int] = []
            ends: list[int] = []
            if len(bucket) > 300_000:
                bucket.clear()
            for sentence in sentences(text or ""):
                own = set(sentence)
                for w in own.difference(bucket):
                    bucket[w] = xxhash.xxh32_intdigest(w) % BUCKETS
                words += map(bucket.__getitem__, own)
                ends.append(len(words))
            if ends:
                yield doc, array("i", words), array("i", ends)

    return _feature_batches(rows())


_FEATURES = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _feature_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 1000)):
        lists = []
        for column in (1, 2):
            values = [np.frombuffer(r[column], np.int32) for r in part]
            offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values))))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), *lists], schema=_FEATURES)


def hashed_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, words, ends): hashed words, and where each sentence ends among them; written once."""
    rows = settled(documents.select("doc_id", "text"), "doc_id").where("doc_id is not null").repartition("doc_id")
    return written(rows.mapInArrow(_features, "doc_id long, words array<int>, ends array<int>"))


def _scores(batch: pa.RecordBatch, weights: np.ndarray | None, subjects: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, sentences of each document, score of each sentence and subject, the words, and where each sentence begins among them."""
    docs = batch.column(0).to_pylist()
    words, ends = batch.column(1), batch.column(2)
    flat = words.flatten().to_numpy(zero_copy_only=False)
    first = np.diff(words.offsets.to_numpy())
    count = np.diff(ends.offsets.to_numpy())
    base = np.cumsum(first) - first
    stop = ends.flatten().to_numpy(zero_copy_only=False) + np.repeat(base, count)
    start = np.concatenate([[0], stop])
    scores = np.zeros((len(stop), subjects)) if weights is None else np.add.reduceat(weights[flat], start[:-1], axis=0).astype(np.float64)
    return docs, count, scores, flat, start


def _slices(batches: Iterator[pa.RecordBatch], docs: dict | set | None) -> Iterator[pa.RecordBatch]:
    """The rows, of some documents or of all, ``AT_ONCE`` at a time."""
    for batch in batches:
        if docs is not None:
            batch = batch.take(pa.array([i for i, d in enumerate(batch.column(0).to_pylist()) if d in docs], pa.int64()))
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _posteriors(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _count(weights: np.ndarray | None, labels: dict[int, list[int]], subjects: int):
    """Counts of words for each subject: by the labels alone without ``weights``, else by the
    posteriors of every sentence, a labelled one among its document's subjects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS * subjects)
        cells: list[np.ndarray] = []
        shares: list[np.ndarray] = []
        waiting = 0
        for batch in _slices(batches, labels if weights is None else None):
            docs, count, scores, flat, start = _scores(batch, weights, subjects)
            if weights is None:
                mask = np.zeros((len(docs), subjects))
            else:  # a sentence that says little goes the way of its document
                hits = _per_document(_hits(scores), count)
                mask = np.where(hits.any(axis=1, keepdims=True), hits + DOCUMENT_PRIOR, 0)
            for i, doc in enumerate(docs):
                if own := labels.get(doc):
                    mask[i, [c for c in range(subjects) if c not in own]] = 0
                    mask[i, own] += 1
            p = _posteriors(scores) * np.repeat(mask, count, axis=0)
            s = p.sum(axis=1, keepdims=True)
            p = np.divide(p, s, out=np.zeros_like(p), where=s > 0)
            i, c = np.nonzero(p > SLIGHT)
            length = (start[1:] - start[:-1])[i]
            ends = np.cumsum(length)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[i] - ends + length, length)
            cells.append(flat[at] * np.int32(subjects) + np.repeat(c.astype(np.int32), length))
            shares.append(np.repeat(p[i, c], length))
            waiting += len(at)
            if waiting > HELD:
                held += np.bincount(np.concatenate(cells), np.concatenate(shares), len(held))
                cells, shares, waiting = [], [], 0
        if waiting:
            held += np.bincount(np.concatenate(cells), np.concatenate(shares), len(held))
        held = held.reshape(BUCKETS, subjects).astype(np.float32)
        some = np.flatnonzero(held.any(axis=1))
        for at in range(0, len(some), 20_000):
            part = some[at : at + 20_000]
            columns = [pa.array(part.astype(np.int32)), *(pa.array(held[part, c]) for c in range(subjects))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f"c{c}" for c in range(subjects))])

    return run


def _counts(features: DataFrame, weights: np.ndarray | None, labels: dict[int, list[int]], subjects: int) -> np.ndarray:
    """The summed counts: one small matrix, whatever the corpus."""
    names = [f"c{c}" for c in range(subjects)]
    parts = features.mapInArrow(_count(weights, labels, subjects), "bucket int, " + ", ".join(f"{c} float" for c in names))
    rows = parts.groupBy("bucket").agg(*(F.sum(c).cast("float").alias(c) for c in names)).toPandas()
    out = np.zeros((BUCKETS, subjects))
    out[rows["bucket"].to_numpy()] = rows[names].to_numpy()
    return out


def complement_weights(counts: np.ndarray, least: int = MIN_COUNT) -> np.ndarray:
    """Complement naive Bayes: what a word says for a subject is how rare it is in all others."""
    every = counts.sum(axis=1, keepdims=True)
    other = every - counts + ALPHA
    weights = -np.log(other / other.sum(axis=0, keepdims=True))
    weights -= weights.mean(axis=1, keepdims=True)
    weights[(every[:, 0] < least) | (counts.max(axis=1) < CONCENTRATION * every[:, 0])] = 0
    return weights.astype(np.float32)


def _hits(scores: np.ndarray) -> np.ndarray:
    """1 for the subject that a sentence deals with."""
    top = np.partition(scores, -2, axis=1)
    clear = np.flatnonzero(top[:, -1] - top[:, -2] >= LEAD)
    hit = np.zeros_like(scores)
    hit[clear, scores[clear].argmax(axis=1)] = 1
    return hit


def _per_document(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(count) - count, axis=0) if len(count) else np.zeros((0, values.shape[1]))


def _share(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[list[int], np.ndarray]:
    """doc_id, and the share of each subject among the sentences on any."""
    docs, count, scores, _flat, _start = _scores(batch, weights, weights.shape[1])
    hits = _per_document(_hits(scores), count)
    return docs, hits / np.maximum(hits.sum(axis=1, keepdims=True), 1)


def _shares(weights: np.ndarray, only: dict[int, list[int]]):
    """Shares of the subjects of the documents in ``only``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, only):
            docs, share = _share(batch, weights)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(share.tolist(), pa.list_(pa.float64()))], ["doc_id", "share"])

    return run


def _judged(weights: np.ndarray, slope: np.ndarray, cut: np.ndarray, names: list[str]):
    """The calibrated posterior of each subject that a document has any sentence on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, None):
            docs, share = _share(batch, weights)
            i, c = np.nonzero(share)
            posterior = 1 / (1 + np.exp(-slope[c] * (share[i, c] - cut[c])))
            yield pa.RecordBatch.from_arrays([pa.array([docs[k] for k in i], pa.int64()), pa.array([names[k] for k in c], pa.string()), pa.array(posterior)], ["doc_id", "subject", "posterior"])

    return run


def calibrated_cut(share: np.ndarray, truth: np.ndarray, centre: float = SHARE, pseudo: int = 8) -> tuple[float, float]:
    """(slope, share at which the posterior is one half) of the most likely logistic curve.

    Labels are wrong at the rate ``MISLABELLED``, which keeps a wrong label of a
    clear document from bending the curve. A few pseudo-documents on both sides of
    ``centre`` decide where there are no others.
    """
    x = np.concatenate([share, np.tile([centre - 0.08, centre + 0.08], pseudo)])
    y = np.concatenate([truth, np.tile([0.0, 1.0], pseudo)])
    best = (-np.inf, 0.0, 0.0)
    for slope in (10.0, 20.0, 40.0, 80.0):
        for cut in np.arange(0.2, 0.451, 0.01):
            p = MISLABELLED + (1 - 2 * MISLABELLED) / (1 + np.exp(-np.clip(slope * (x - cut), -30, 30)))
            best = max(best, (float(np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))), slope, float(cut)))
    return best[1], best[2]


class SubjectModel:
    """Weights of the words, names of the subjects and the calibrated cut of each."""

    def __init__(self, weights: np.ndarray, names: list[str], slope: np.ndarray, cut: np.ndarray) -> None:
        self.weights, self.names, self.slope, self.cut = weights, names, slope, cut


def labelled(labels: DataFrame, names: list[str]) -> dict[int, list[int]]:
    """Subjects of ``MAX_LABELLED`` labelled documents or, of more, of about so many, drawn by a hash of doc_id."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(names)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    n = rows.count()
    if n > MAX_LABELLED:  # a threshold on the hash: tasks send what is drawn and no more
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int((1 << 32) * MAX_LABELLED / n))
    at = {name: i for i, name in enumerate(names)}
    return {r["doc_id"]: [at[s] for s in r["subjects"]] for r in rows.collect()}


def fit(features: DataFrame, labels: DataFrame, areas: DataFrame, hold_out: int = 0) -> SubjectModel:
    """The model; with ``hold_out`` every so-manieth labelled document is left out, for tests."""
    names = sorted(r[0] for r in areas.where("subject is not null").select("subject").distinct().collect())
    known = labelled(labels, names)
    if hold_out:
        known = {d: s for d, s in known.items() if d % hold_out}
    k = len(names)
    weights = complement_weights(_counts(features, None, known, k), MIN_LABELLED)
    for _ in range(ROUNDS):
        weights = complement_weights(_counts(features, weights, known, k))
    rows = features.mapInArrow(_shares(weights, known), "doc_id long, share array<double>").collect()
    share = np.array([r["share"] for r in rows]).reshape(-1, k)
    truth = np.zeros_like(share)
    for i, r in enumerate(rows):
        truth[i, known[r["doc_id"]]] = 1
    _, common = calibrated_cut(share.ravel(), truth.ravel())  # what the subjects have in common, then each on its own
    fits = [calibrated_cut(share[:, c], truth[:, c], common) for c in range(k)]
    return SubjectModel(weights, names, np.array([f[0] for f in fits]), np.array([f[1] for f in fits]))


def subject_posteriors(documents: DataFrame, labels: DataFrame, areas: DataFrame, hold_out: int = 0) -> DataFrame:
    """(doc_id, subject, posterior) of each subject that a document has any sentence on.

    Posteriors of a document's subjects are independent and need not add up to one. A null, empty
    or unreadable text has no row; repeated rows count once; without labels or areas nothing can be
    learned, and the result is empty.
    """
    spark = documents.sparkSession
    schema = "doc_id long, subject string, posterior double"
    if areas.where("subject is not null").isEmpty() or labels.isEmpty():
        return spark.createDataFrame([], schema)
    features = hashed_sentences(documents)
    model = fit(features, labels, areas, hold_out)
    return features.mapInArrow(_judged(model.weights, model.slope, model.cut, model.names), schema)


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, hold_out: int = 0) -> DataFrame:
    """(doc_id, subject): a row for each subject whose posterior is one half or more."""
    return subject_posteriors(documents, labels, areas, hold_out).where("posterior >= 0.5").select("doc_id", "subject")


def composition(found: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents are about each subject, and their share of all that are about any."""
    weighed = found.join(found.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    total = found.select("doc_id").distinct().count()
    return weighed.groupBy("subject").agg(F.count("*").alias("documents"), (F.sum(1 / F.col("n")) / max(1, total)).alias("share"))
