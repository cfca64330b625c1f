"""Soft-membership mixing: domain posteriors by a classifier fit on a labelled table, and document rates by least squares.

The classifier is a multinomial logistic regression over the presence of words, word beginnings and a few shapes of the
text, of which those that tell a domain best are chosen. It is fit on at most ``SAMPLE`` labelled documents, those of ``docs`` whose hashed
ids come first; that bound is a parameter. Their texts are read where they are: the driver gets counts of hashed features, and of
each document which of the few hundred chosen ones it has. Everything else covers all rows.

With w the document rates, t their tokens and p their posteriors, the expected tokens of domain d are sum(w t p_d). The
rates minimise the squared distance of these totals from the targets, in the metric of the inverse of H = sum(t p p') and a
small multiple of the identity, which puts the domains on one scale. Starting from rates of one, projected gradient steps keep 0 <= w <= ``max_rate``,
with momentum (Nesterov's, begun anew when the distance grows); the gradient is taken where each document weighs as its
tokens, so a document's rate follows from its posteriors and not its length. A step needs of a document only p, the step's vector of one
number a domain and its momentum, so a pass recomputes w from the steps so far, sums the totals where the rows are, and sends a few
sums a batch. No rate is kept between passes and nothing is shuffled but those sums. A mix that misses its targets warns of it.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planeweave.llm.common import bounded, cut_lineage, free_name, utf8_column
from planeweave.llm.tokens import chunk_table

#: Labelled documents that the classifier is fit on, at most.
SAMPLE = 8192
#: Hashed features, and those chosen for each domain.
SLOTS, CHOSEN = 1 << 18, 128
LEAST_DOCS, FIT_STEPS, RIDGE = 5, 150, 1e-4
#: Steps end when all totals are within this share of the budget, or move by less twice; and the share that a mix may miss unsaid.
STEPS, TOLERANCE, MISSED = 100, 2e-5, 0.01
#: Added to H, as a share of all tokens: a domain that hardly occurs counts little, instead of ruling the others.
LEAST_SHARE = 0.01
EDGES = ".,!?;:\"'()"
SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
#: Letters of a word's beginnings.
BEGINNINGS = (4, 5)


def _slot(key: str) -> int:
    return zlib.crc32(key.encode()) % SLOTS


def told_by(word: str) -> list[str]:
    """What a lower-case word tells: itself without marks at its end, and its first four and five letters."""
    bare = word.rstrip(EDGES)
    return [*([f" {bare} "] if bare else []), *(f" {word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def _spaced(text: bytes) -> str:
    """In lower case, with a space for each white space and around."""
    return f" {text.translate(SPACES).decode().lower()} "


def shapes(text: bytes, words: int, distinct: int) -> list[str]:
    """A text's shapes: steps of the shares of distinct words, symbols and capitals, and of letters a word."""
    n = max(1, words)
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>!"))
    capitals = len(text) - len(text.translate(None, bytes(range(65, 91))))
    steps = ("distinct", 20 * distinct // n), ("symbols", min(20, 20 * symbols // n)), ("capitals", min(20, 5 * capitals // n)), ("letters", min(20, len(text) // n))
    return [f"~ {name} {step}" for name, step in steps]


def features(text: bytes) -> set[str]:
    """All that a text tells."""
    words = text.split()
    distinct = {w for w in _spaced(text).split(" ") if w}
    return {f for w in distinct for f in told_by(w)} | set(shapes(text, len(words), len(set(words))))


@dataclass
class Classifier:
    """place: the chosen features, each with its row of ``weights``, which has a column for each domain."""

    domains: list[str]
    place: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        self.finder = None

    def _build(self) -> None:
        """An automaton that finds all words and beginnings in one pass over a text."""
        import ahocorasick

        self.finder = ahocorasick.Automaton()
        for f, row in self.place.items():
            if f[-1] == " ":
                for mark in f" {EDGES}":  # a word is found with what follows it
                    self.finder.add_word(f[:-1] + mark, (row, mark != " "))
            elif f[0] == " ":
                self.finder.add_word(f, (row, False))
        if len(self.finder):
            self.finder.make_automaton()

    def _rows(self, text: str) -> set[int]:
        at: set[int] = set()
        if not len(self.finder):
            return at
        for end, (row, marked) in self.finder.iter(text):
            if not marked or not text[end : text.index(" ", end)].strip(EDGES):
                at.add(row)
        return at

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        if self.finder is None:
            self._build()
        z = np.empty((len(texts), len(self.domains)))
        for i, text in enumerate(texts):
            words = text.split()
            at = self._rows(_spaced(text))
            at.update(self.place[s] for s in shapes(text, len(words), len(set(words))) if s in self.place)
            z[i] = self.weights[sorted(at)].sum(axis=0) + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(texts) else z
        return p / p.sum(axis=1, keepdims=True)


def _slots(text: bytes) -> list[int]:
    return sorted({_slot(f) for f in features(text)})


def choose(df: np.ndarray, size: np.ndarray) -> list[int]:
    """Rows of ``df`` (documents with a feature, by domain) that tell a domain best; ``size``: all documents by domain."""
    total, n, chosen = df.sum(axis=1), size.sum(), set()
    for c in range(len(size)):
        gap = (df[:, c] + 0.5) / (size[c] + 1) - (total - df[:, c] + 0.5) / (n - size[c] + 1)
        spread = np.sqrt((total + 1) / n * (1 - total / (n + 1)) * (1 / (size[c] + 1) + 1 / (n - size[c] + 1)))
        z = np.where(total >= LEAST_DOCS, gap / spread, 0)
        best = np.argsort(-z, kind="stable")[:CHOSEN]
        chosen |= set(best[z[best] > 0].tolist())
    return sorted(chosen)


def train(found: list[list[int]], y: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases from each document's features (below ``width``) and its domain."""
    n, size = len(found), np.bincount(y, minlength=k)
    at, doc = np.array([f for x in found for f in x], np.int64), np.repeat(np.arange(n), [len(x) for x in found])
    w, b, target = np.zeros((width, k)), np.log((size + 0.5) / (n + 0.5 * k)), np.eye(k)[y]
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, FIT_STEPS + 1):
        z = np.stack([np.bincount(doc, weights=w[at, c], minlength=n) for c in range(k)], axis=1) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        off = p / p.sum(axis=1, keepdims=True) - target
        grad = np.stack([np.bincount(at, weights=off[doc, c], minlength=width) for c in range(k)], axis=1) / n + RIDGE * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w -= 0.1 * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        b -= 0.05 * off.mean(axis=0)
    return w, b


def fit_classifier(rows: list[tuple[bytes, str]], domains: list[str]) -> Classifier:
    """From (text, domain) rows at hand. A domain without rows gets a posterior near zero; without any rows all are as likely."""
    k = len(domains)
    if not rows:
        return Classifier(domains, {}, np.zeros((0, k)), np.zeros(k))
    y = np.array([domains.index(d) for _, d in rows])
    found = [_slots(t) for t, _ in rows]
    df = np.zeros((SLOTS, k), np.int64)
    for slots, c in zip(found, y, strict=True):
        df[slots, c] += 1
    place = {s: i for i, s in enumerate(choose(df, np.bincount(y, minlength=k)))}
    w, b = train([[place[s] for s in x if s in place] for x in found], y, k, len(place))
    # the features of the chosen slots; their slot's row is theirs
    return Classifier(domains, {f: place[s] for t, _ in rows for f in features(t) if (s := _slot(f)) in place}, w, b)


def labelled_sample(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, size: int = SAMPLE) -> list[tuple[int, str]]:
    """At most ``size`` (id, domain) rows of ``labelled`` (id, domain): those that are in ``docs`` and whose hashed ids come first."""
    known = labelled.where(F.col("domain").isin(domains)).groupBy(F.col("id").cast("long").alias("id")).agg(F.min("domain").alias("domain"))
    there = docs.select(F.col(id_col).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return [(r.id, r.domain) for r in known.join(there, "id").orderBy(F.xxhash64("id"), "id").limit(size).collect()]


def fit_on(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, size: int = SAMPLE) -> Classifier:
    """The classifier of ``labelled_sample``'s documents, as ``fit_classifier`` would find it. Of rows with one id one counts."""
    spark, k = docs.sparkSession, len(domains)
    chosen_ids = labelled_sample(docs, labelled, domains, id_col, text_col, size)
    if not chosen_ids:
        return fit_classifier([], domains)
    first = F.broadcast(spark.createDataFrame(chosen_ids, "id long, domain string"))  # ``size`` rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(first, "id")

    def slots_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            found = pa.array(map(_slots, utf8_column(batch, "text")), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), found], ["id", "domain", "order", "slots"])

    told = rows.withColumn("order", F.xxhash64("text")).mapInArrow(slots_of, "id long, domain string, order long, slots array<int>")
    sample = cut_lineage(told.groupBy("id").agg(F.min_by(F.struct("domain", "slots"), "order").alias("x")).select("id", "x.*"))
    by_domain = [F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    size_of = np.array(sample.agg(*by_domain).first())
    # as many rows at most as there are slots
    common = sample.select("domain", F.explode("slots").alias("slot")).groupBy("slot").agg(*by_domain, F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCS).toArrow()
    df = np.zeros((SLOTS, k), np.int64)
    at = common["slot"].to_numpy()
    for i in range(k):
        df[at, i] = common[f"n{i}"].to_numpy()
    place = {s: i for i, s in enumerate(choose(df, size_of))}
    held = F.array(*map(F.lit, place)) if place else F.array().cast("array<int>")
    found = sample.orderBy("id").select("domain", F.array_intersect("slots", held).alias("slots")).toArrow()
    y = np.array([domains.index(d) for d in found["domain"].to_pylist()])
    w, b = train([sorted(place[s] for s in x) for x in found["slots"].to_pylist()], y, k, len(place))

    def names_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            yield pa.record_batch({"name": pa.array(sorted({f for t in utf8_column(batch, "text") for f in features(t) if _slot(f) in place}), pa.string())})

    names = [r.name for r in rows.select("text").mapInArrow(names_of, "name string").distinct().collect()]
    return Classifier(domains, {f: place[_slot(f)] for f in sorted(names)}, w, b)


def rates(posteriors: np.ndarray, history: np.ndarray, max_rate: float) -> np.ndarray:
    """The rates of documents with ``posteriors`` (a row each) after the steps in ``history``, whose last column is the momentum."""
    w = was = np.ones(len(posteriors))
    for step in history:
        w, was = np.clip(w + step[-1] * (w - was) - posteriors @ step[:-1], 0.0, max_rate), w
    return w


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


def _totals(members: DataFrame, history: np.ndarray, max_rate: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows of (n_tokens, posteriors): expected tokens by domain, and H."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, p = batch.column(0).to_numpy(), _matrix(batch.column(1), k)
            sums = [*((rates(p, history, max_rate) * t) @ p), *((p * t[:, None]).T @ p).ravel()]
            yield pa.record_batch({"i": pa.array(range(len(sums)), pa.int32()), "v": pa.array(sums, pa.float64())})

    rows = members.select("n_tokens", "posteriors").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(k + k * k)
    for r in rows:
        sums[r.i] = r.v
    return sums[:k], sums[k:].reshape(k, k)


def solve(members: DataFrame, weights: dict[str, float], domains: list[str], total: float | None, max_rate: float) -> tuple[np.ndarray, dict]:
    """The steps that lead to the rates, and what was reached. Domains with no tokens are left out of the targets."""
    k = len(domains)
    have, gram = _totals(members, np.zeros((0, k + 1)), max_rate, k)
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains]) * (have > 0)
    share = share / share.sum() if share.sum() else share
    if total is None:
        total = float(have.sum())  # posteriors sum to one, so these are all tokens
    elif np.isinf(total):
        total = min((max_rate * have[d] / share[d] for d in range(k) if share[d] > 0), default=0.0)
    target = share * total
    inverse = np.linalg.inv(gram + LEAST_SHARE * max(have.sum(), 1.0) * np.eye(k))
    apart = lambda x: float((x - target) @ inverse @ (x - target))
    history, reached, before, pace, still = np.zeros((0, k + 1)), have, have, 1.0, 0
    while len(history) < STEPS and have.sum() and np.abs(reached - target).max() > TOLERANCE * max(total, 1.0) and still < 2:
        after = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        momentum = (pace - 1) / after if apart(reached) <= apart(before) else 0.0
        pace = after if momentum or pace == 1 else 1.0
        here = reached + momentum * (reached - before)  # totals are linear in the rates
        history = np.concatenate([history, [[*(inverse @ (here - target)), momentum]]])
        before, (reached, _) = reached, _totals(members, history, max_rate, k)
        still = still + 1 if np.abs(reached - before).max() <= TOLERANCE * max(total, 1.0) else 0
    missed = float(np.abs(reached - target).max())
    if missed > MISSED * max(total, 1.0):
        warnings.warn(f"the mix misses its targets by up to {missed:.0f} of {total:.0f} tokens: {dict(zip(domains, reached.round().tolist(), strict=True))}", stacklevel=2)
    return history, {"domains": domains, "target": target.tolist(), "available": have.tolist(), "reached": reached.tolist(), "steps": len(history), "missed": missed}


def _members(df: DataFrame, text_col: str, model: Classifier, path: str) -> DataFrame:
    """``df`` with n_tokens and posteriors instead of its text."""
    rest = [f for f in df.schema.fields if f.name != text_col]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            texts = utf8_column(batch, text_col)
            p = shared.value.posteriors(texts)
            tokens = [sum(v) for v in chunk_table(path, True).of(texts)]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            found = [pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())]
            yield pa.RecordBatch.from_arrays([*columns, *found], [*(f.name for f in rest), "n_tokens", "posteriors"])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]))


def _with_rate(df: DataFrame, text_col: str, model: Classifier, history: np.ndarray, max_rate: float, name: str) -> DataFrame:
    """``df`` with its rates in ``name``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            w = rates(shared.value.posteriors(utf8_column(batch, text_col)), history, max_rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(w, pa.float64())], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def _rated(members: DataFrame, history: np.ndarray, max_rate: float) -> DataFrame:
    k = history.shape[1] - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(batch.schema.get_field_index("posteriors")), k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates(p, history, max_rate), pa.float64())], [*batch.schema.names, "rate"])

    return members.mapInArrow(run, T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())]))


def _copies(rate: str, key: str) -> Column:
    """A number in [0, 1) of the id's hash decides between the two nearest counts, so the expected count is the rate."""
    draw = F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit("mixing")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(F.col(rate) + draw).cast("int")


def plan(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], path: str, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, max_rate: float = 4.0, sample: int = SAMPLE) -> tuple[DataFrame, dict]:
    """``mix``'s rows, and a report: domains, their targets, what is available and what the rates reach in expected tokens, the steps
    taken, and by how many tokens the mix misses at most."""
    domains = sorted(weights)
    model = fit_on(docs, labelled, domains, id_col, text_col, sample)
    members = cut_lineage(_members(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", model, path))
    history, report = solve(members, weights, domains, total, max_rate)
    return _rated(members, history, max_rate).select(F.col("id").alias(id_col), "n_tokens", "posteriors", "rate", _copies("rate", "id").alias("copies")), report


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], path: str, id_col: str = "doc_id", text_col: str = "text", total: float | None = None, max_rate: float = 4.0, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: id_col, n_tokens, posteriors (in the order of the sorted domain names), rate, copies.

    ``labelled`` has columns id and domain; rows of domains that ``weights`` doesn't name are left out, of several for an
    id the first by name counts, and labels of no document here do nothing. ``total`` is the token budget: by default all tokens
    of ``docs``, infinite for the most that the weights and ``max_rate`` allow. Targets that can't be met are approached as far as
    they can be, with a warning.

    A null or empty text has no tokens and the rate of its posteriors; a null id stays null and is never labelled. A text of any
    length is read whole. Rows with the same id and text get the same rate and copies. An empty table gives no rows, one without
    labels rates by equal posteriors. Further columns, whatever their names, are left out.
    """
    return plan(docs, labelled, weights, path, id_col, text_col, total, max_rate, sample)[0]


def thin(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], path: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with their columns, that a mix without repeats (rates up to one) draws, as many tokens as that allows.

    Whether a row is drawn follows from its id's hash and its text, so repeated rows stay or go together. Null and empty texts, null
    ids, long texts, ties and empty tables are treated as by ``mix``; columns of any name are kept as they are.
    """
    domains = sorted(weights)
    model = fit_on(docs, labelled, domains, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    history, _ = solve(cut_lineage(_members(rows, "text", model, path)), weights, domains, np.inf, 1.0)
    rate = free_name(docs, "_rate")
    return _with_rate(docs, text_col, model, history, 1.0, rate).where(_copies(rate, id_col) > 0).select(*(F.col(f"`{c}`") for c in docs.columns))
