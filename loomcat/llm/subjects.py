"""Subject areas of documents: sentence shares from a term model, and a classifier chain decoded by beam search.

The term model tells for each sentence which subject it treats, if any; it is fitted by expectation-maximisation on
labelled documents, whose labels say which subjects their sentences may have. A chain of logistic classifiers, one per
subject in order of frequency, sees the shares of the sentences, the source, the structure of the text and the labels
decided before it, so subjects that occur together support each other; the best combination of labels is searched for
with a beam. Both are fitted on at most `LABELLED` labelled documents, each half with term weights from the other half,
so that the chain's probabilities are calibrated on documents the term model has not seen.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomcat.session import fixed_rows

#: Most labelled documents that are used to fit; the bound of the sample, and so of the terms and models.
LABELLED = 6000
#: Share of the sentences with a subject from which a subject counts.
SHARE = 0.25
BEAM = 6
#: Sentences remembered in one task; a bound on memory.
MEMO = 100_000
#: Subjects at most: a fixed vocabulary.
SUBJECTS = 1000
ROUNDS = 4
#: Share of a term's uses that must be of one subject for the term to tell it.
PURE = 0.55

_SPEAKER = re.compile(r"^\s*[a-z]+\d+\s*:\s*", re.I)
_NUMBERED = re.compile(r"^\s*\d+[.)]\s+")
_BULLET = re.compile(r"^\s*[-*•]\s+")
_LEAD = re.compile(r"^[ \t]*(?:[a-z]+\d+[ \t]*:[ \t]*)?(?:\d+[.)][ \t]+)?(?:[-*•][ \t]+)?", re.M)
_END = re.compile(r"(?<=[.!?])[\s]+(?=[^\s\d])")
_WORD = re.compile(r"[^\W_]+")
FEATURES = 8  # of the structure and size, see structure()


def repaired(text: str) -> str:
    """Text whose utf-8 bytes had been read as a single-byte code, read again; other text as it is."""
    if "Ã" in text or "â€" in text or "Â" in text:
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except UnicodeError:
                continue
        return re.sub(r"Ã.", lambda m: m[0].encode("cp1252", "ignore").decode("utf-8", "ignore") or m[0], text)
    return text


class _Letters(dict):
    """A table for str.translate that drops accents and invisible characters; filled as characters are met."""

    def __missing__(self, code: int) -> int | None:
        c = chr(code)
        self[code] = None if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else code
        return self[code]


_LETTERS = _Letters()
#: Markup of any length: a tag's name follows its bracket, which tells it from a sign.
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")


def plain(text: str) -> str:
    """Lower case, without accents and invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LETTERS)
    return text.lower()


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence; numbers, bullets and speakers at the start of lines are no words, nor are numbers."""
    s = repaired(text or "")
    if "<" in s:
        s = _TAG.sub(" ", s)
    out = []
    for line in _LEAD.sub("", plain(s)).splitlines():
        for part in _END.split(line):
            words = [w for w in _WORD.findall(part) if not w.isdigit()]
            if words:
                out.append(words)
    return out


def terms_of(words: list[str]) -> list[str]:
    """Words, and runs of two and three words."""
    two = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    three = [f"{a} {b}" for a, b in zip(two, words[2:], strict=False)]
    return words + two + three


def structure(text: str, source: str | None, n_sentences: int) -> list[float]:
    """Features of a document besides its terms."""
    lines = [x for x in text.splitlines() if x.strip()] or [""]
    s = (source or "").lower()
    share = lambda p: sum(bool(p.match(x)) for x in lines) / len(lines)
    return [share(_NUMBERED), share(_BULLET), share(_SPEAKER), np.log1p(n_sentences), *(float(x in s) for x in ("product", "manual", "thread", "note"))]


class TermModel:
    """Log-ratios of terms that tell a subject; a sentence without such a term has no subject."""

    def __init__(self, terms: list[str], weights: np.ndarray, k: int):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.weights, self.k = weights, k
        self.memo: dict[str, tuple[int, float]] = {}

    def subject(self, words: list[str]) -> tuple[int, float]:
        """Number of the subject that a sentence treats, or -1, and how clearly its terms tell it. Sentences recur, so they are remembered (bounded)."""
        key = " ".join(words)
        best = self.memo.get(key)
        if best is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ids = [i for i in map(self.terms.get, terms_of(words)) if i is not None]
            best = -1, 0.0
            if ids:
                sums = self.weights[ids].sum(0)
                first = int(sums.argmax())
                most, sums[first] = float(sums[first]), -3.0
                best = first, (most - float(sums.max())) / len(ids)
            self.memo[key] = best
        return best

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """Sentences by subject, then the mean margin of their terms by subject; and the number of all sentences."""
        n = np.zeros(2 * self.k)
        told = sentences(text)
        for words in told:
            best, margin = self.subject(words)
            if best >= 0:
                n[best] += 1
                n[self.k + best] += margin
        n[self.k :] /= np.maximum(n[: self.k], 1)
        return n, len(told)


def _telling(by_class: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Terms most of whose uses are of one subject; of rare terms nearly all must be."""
    return (by_class.max(1) + 0.5) / (total + 1.5) >= PURE


def fit_terms(texts: list[list[list[str]]], labels: np.ndarray) -> TermModel:
    """texts: sentences of each document; labels: documents by subjects. EM over the subjects of the sentences.

    It starts from terms found in documents of mostly one subject. Sentences are then given the subjects of their
    telling terms, weighed by the document's labels, and terms are judged again by the sentences they are in.
    """
    k = labels.shape[1]
    often: Counter = Counter()
    for told in texts:
        often.update({t for words in told for t in terms_of(words)})
    vocabulary = {t: i for i, t in enumerate(t for t, n in often.items() if n >= 2)}
    del often
    ids, starts, owner = [], [], []
    for d, told in enumerate(texts):
        for words in told:
            own = [i for t in terms_of(words) if (i := vocabulary.get(t)) is not None]
            if own:
                starts.append(len(ids))
                owner.append(d)
                ids += own
    v = len(vocabulary)
    if not ids:
        return TermModel([], np.zeros((0, k)), k)
    term, at, owner = np.array(ids), np.array(starts), np.array(owner)
    sentence = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(term)]))
    doc = owner[sentence]
    once = np.unique(term.astype(np.int64) * len(texts) + doc)
    t1, d1 = once // len(texts), once % len(texts)
    of_doc = labels / np.maximum(labels.sum(1, keepdims=True), 1)
    by_class = np.stack([np.bincount(t1, weights=of_doc[d1, c], minlength=v) for c in range(k)], 1)
    total = np.bincount(t1, minlength=v).astype(float)
    base = np.maximum(of_doc.mean(0), 1e-4)
    allowed = np.where(labels > 0, 1.0, 0.05)[owner]
    for _ in range(ROUNDS):
        keep = _telling(by_class, total)
        logs = np.log((by_class + 0.3 * base) / (total[:, None] + 0.3) / base) * keep[:, None]
        z = np.add.reduceat(logs[term], at, axis=0)
        told = np.add.reduceat(keep[term].astype(int), at) > 0
        z = z + np.log(allowed)
        z -= z.max(1, keepdims=True)
        share = np.exp(z)
        share = share / share.sum(1, keepdims=True) * told[:, None]
        by_class = np.stack([np.bincount(term, weights=share[sentence, c], minlength=v) for c in range(k)], 1)
        total = np.bincount(term, minlength=v).astype(float)
        base = np.maximum(share.sum(0) / max(told.sum(), 1), 1e-4)
    keep = np.flatnonzero(_telling(by_class, total))
    names = list(vocabulary)
    logs = np.log((by_class[keep] + 0.3 * base) / (total[keep, None] + 0.3) / base)
    return TermModel([names[i] for i in keep], logs.astype(np.float32), k)


def _columns(counts: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Features of all labels: shares, counts and margins of terms; their total; and those of source and structure."""
    k = counts.shape[1] // 2
    n, margins = counts[:, :k], counts[:, k:]
    total = n.sum(1, keepdims=True)
    return np.c_[n / np.maximum(total, 1), np.minimum(n, 20) / 10, np.minimum(margins, 10) / 5, np.minimum(total, 40) / 10, extra]


def _for_label(x: np.ndarray, k: int, j: int, before: np.ndarray) -> np.ndarray:
    share, count, margin = x[:, j], x[:, k + j], x[:, 2 * k + j]
    others = np.delete(x[:, :k], j, axis=1)
    return np.c_[np.ones(len(x)), share, share >= SHARE, np.minimum(share, SHARE), count, margin, share * x[:, 3 * k], others.max(1, initial=0), (others >= SHARE).sum(1), x[:, 3 * k :], before]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Classifiers in order of frequency, each seeing the labels before it, with their odds calibrated on held-out rows.

    Each half of the rows is judged by a chain fitted to the other half; a line through these odds and the true labels
    (Platt's scaling) then corrects the chain that is fitted to all rows. `calibrated` keeps the mean log loss of the
    held-out rows before and after.
    """

    def __init__(self, x: np.ndarray, labels: np.ndarray, calibrate: bool = True):
        self.k = labels.shape[1]
        self.order = np.argsort(-labels.sum(0), kind="stable")
        self.weights = [_logistic(_for_label(x, self.k, j, labels[:, self.order[:i]]), labels[:, j]) for i, j in enumerate(self.order)]
        self.lines = np.tile([0.0, 1.0], (self.k, 1))
        self.calibrated = (0.0, 0.0)
        if calibrate and len(x) >= 20:
            z = np.zeros_like(labels)
            for half in (0, 1):
                part = Chain(x[half::2], labels[half::2], calibrate=False)
                for j in self.order:  # the labels before are the true ones, as in the fit
                    seen = part.order.tolist().index(j)
                    z[1 - half :: 2, j] = _for_label(x[1 - half :: 2], self.k, j, labels[1 - half :: 2][:, part.order[:seen]]) @ part.weights[seen]
            z = np.clip(z, -30, 30)
            loss = lambda q: float(np.mean(np.logaddexp(0, np.where(labels > 0, -q, q))))
            self.lines = np.stack([_logistic(np.c_[np.ones(len(x)), z[:, j]], labels[:, j], ridge=1e-3) for j in range(self.k)])
            self.calibrated = loss(z), loss(z * self.lines[:, 1] + self.lines[:, 0])

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The likeliest combination of labels of each row, by a beam over the chain."""
        n = len(x)
        beams = [(np.zeros(n), np.zeros((n, 0)))]
        for j, w in zip(self.order, self.weights, strict=True):
            grown = []
            for score, before in beams:
                z = np.clip(self.lines[j, 0] + self.lines[j, 1] * (_for_label(x, self.k, j, before) @ w), -30, 30)
                for label, log in ((0.0, -np.logaddexp(0, z)), (1.0, -np.logaddexp(0, -z))):
                    grown.append((score + log, np.c_[before, np.full(n, label)]))
            if len(grown) > BEAM:
                scores = np.stack([g[0] for g in grown])
                paths = np.stack([g[1] for g in grown])
                top = np.argsort(-scores, axis=0, kind="stable")[:BEAM]
                grown = [(scores[t, np.arange(n)], paths[t, np.arange(n)]) for t in top]
            beams = grown
        scores = np.stack([b[0] for b in beams])
        best = np.stack([b[1] for b in beams])[scores.argmax(0), np.arange(n)]
        out = np.zeros_like(best)
        out[:, self.order] = best
        return out


def fit(rows: list[tuple[str, str | None, frozenset]], subjects: list[str]) -> tuple[TermModel, Chain]:
    """rows: text, source, subjects of labelled documents."""
    labels = np.array([[float(s in row[2]) for s in subjects] for row in rows]).reshape(len(rows), len(subjects))
    told = [sentences(r[0]) for r in rows]
    counts = np.zeros((len(rows), 2 * len(subjects)))
    for half in (0, 1):
        model = fit_terms([t for i, t in enumerate(told) if i % 2 == half], labels[half::2])
        for i in range(1 - half, len(rows), 2):
            counts[i] = model.counts(rows[i][0])[0]
    extra = np.array([structure(r[0], r[1], len(t)) for r, t in zip(rows, told, strict=True)]).reshape(len(rows), FEATURES)
    return fit_terms(told, labels), Chain(_columns(counts, extra), labels)


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> list[tuple[str, str | None, frozenset]]:
    """text, source, subjects of at most `most` labelled documents with text, those of lowest hash."""
    by_doc = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    chosen = F.broadcast(by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` rows
    rows = documents.where(F.trim("text") != "").select("doc_id", "text", "source").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [(r["text"], r["source"], frozenset(r["subjects"])) for r in rows.collect()]


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, subject: one row for each subject a document treats, one, several or none.

    Null and blank texts have no row, nor have texts without a sentence on a subject. Without labels or subjects the
    result is empty. One pass over the documents; the models are bounded by LABELLED and the number of subjects.
    """
    spark = documents.sparkSession
    names = sorted(r[0] for r in fixed_rows(subjects.select("subject").where("subject is not null").distinct(), SUBJECTS))
    rows = labelled_sample(documents, labels, most)
    schema = "doc_id long, subject string"
    if not names or not rows:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast((fit(rows, names), names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (model, chain), names = sent.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                found = [model.counts(t) for t in part["text"]]
                counts = np.array([f[0] for f in found])
                extra = np.array([structure(t, s, n) for t, s, (_, n) in zip(part["text"], part["source"], found, strict=True)])
                chosen = chain.decode(_columns(counts, extra)) * (counts[:, : len(names)] > 0)
                doc, subject = np.nonzero(chosen)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[doc], "subject": [names[j] for j in subject]})

    told = documents.where(F.trim("text") != "").select(F.col("doc_id").cast("long"), "text", "source")
    return told.mapInPandas(run, schema)
