"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Each document gives a vector of transformed statistics, kept as integers on a fixed grid. For the documents of each language and
source that pass the base rules, the ``SHARE`` of rows is sought whose covariance has the least determinant: from three
deterministic starts (medians with median absolute deviations, with the covariance of spatial signs, and with that of
tanh-bounded deviations), concentration steps are taken until the determinant falls no more, and the least one wins. A document
is rejected if its squared Mahalanobis distance is beyond the chi-square quantile of ``CUTOFF``.

Small groups need no rule of their own: every estimate is that of the group's rows with ``PRIOR_ROWS`` more that lie as the
whole table does (around its medians, with its deviations), as in the regularized estimator. They count for much in a
group of ten and for nothing in one of a million. The table's deviations themselves start from as many rows of ``USUAL`` ones.

All sums are of integers, quantiles are taken on a grid, and rows within a step of a distance count together, so the verdicts depend
neither on the order of the rows nor on their partitions. A task sends a row of sums for each group, start and step of distance;
estimates go to the rows, by broadcast for all groups that hold one in ``HEAVY`` rows, and no group is brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planeweave.llm.common import bounded, cut_lineage, free_name, join_by, utf8_column

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
WINDOW = 8
#: Words of usual text that are added to a text before its shares are taken, so that short texts don't stand out by a word or two.
PRIOR = 50
#: The vector: log of letters a word; roots of the shares of marks, capital words and echoed words; log of distinct words to log of words.
FEATURES = ("letters", "marks", "capitals", "echoes", "variety")
#: What the added words are like, for the first four, and usual deviations of the vector.
ADDED = (5.0, 0.04, 0.08, 0.006)
USUAL = (0.04, 0.015, 0.03, 0.03, 0.012)
#: Steps of the grid in a unit, and of distance in an octave.
GRID, STEPS_AN_OCTAVE = 1 << 12, 16
SHARE, PRIOR_ROWS, CUTOFF = 0.75, 100, 1 - 1e-9
STARTS = ("deviations", "signs", "tanh")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals", "n_echoes", "n_distinct")
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words (a power of two) found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(known) > len(words) - window // 2 and len(words) - len(known) < window:
        return 0  # two equal windows, even overlapping ones, repeat at least that many words
    ranks = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    width = 1
    while width < window:  # the rank of a window is that of its two halves, so equal ranks are equal words
        ranks = np.unique(ranks[:-width] * (len(words) + 1) + ranks[width:], return_inverse=True)[1]
        width *= 2
    starts = np.bincount(ranks)[ranks] > 1
    if not starts.any():
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(starts)
    cover[:-1] += np.bincount(at, minlength=len(words))
    cover -= np.bincount(at + window, minlength=len(words) + 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics_of(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of a text: the contract's five, then marks, words with a capital (A-Z) at their begin, words equal to the one
    before, and distinct words."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = text.translate(None, SPACE)
    points = len(bare.translate(None, bytes(range(0x80, 0xC0))))
    without = lambda some: len(bare) - len(bare.translate(None, some))
    capitals = sum(65 <= w[0] <= 90 for w in words)
    return len(words), points, without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), without(MARKS), capitals, sum(map(bytes.__eq__, words, words[1:])), len(set(words))


def _with_counts(df: DataFrame, text_col: str, name: str = "_counts") -> DataFrame:
    """``df`` with a column ``name``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text_col):
            counts = pa.array(map(statistics_of, utf8_column(batch, text_col)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))


def _vector(counts: str = "_counts") -> list[Column]:
    """The transformed statistics as integers on the grid."""
    n, chars, _, _, _, marks, capitals, echoes, distinct = (F.col(counts)[i].cast("double") for i in range(len(COUNTS)))
    letters, of_marks, of_capitals, of_echoes = ADDED
    words, all_letters = n + PRIOR, chars + letters * PRIOR
    units = (F.log(all_letters / words), F.sqrt((marks + of_marks * letters * PRIOR) / all_letters), F.sqrt((capitals + of_capitals * PRIOR) / words), F.sqrt((echoes + of_echoes * PRIOR) / words), F.log(distinct + 2) / F.log(n + 2))
    return [F.round(u * GRID).cast("long").alias(name) for u, name in zip(units, FEATURES, strict=True)]


def _base_failed(counts: str = "_counts") -> Column:
    c = F.col(counts)
    return (c[0] < 20) | (100 * c[4] > 30 * c[0])


def chi_square(x: float, k: int) -> float:
    """P(chi-square with ``k`` degrees of freedom <= x)."""
    if k % 2:
        tail, term, start = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 1
    else:
        tail, term, start = math.exp(-x / 2), math.exp(-x / 2) * x / 2, 2
    for i in range(start, k, 2):
        tail, term = tail + term, term * x / (i + 2)
    return 1 - tail


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < p else (low, mid)
    return high


#: What makes the covariance of the nearest ``SHARE`` of normal rows that of all.
CONSISTENT = SHARE / chi_square(chi_square_quantile(SHARE, len(FEATURES)), len(FEATURES) + 2)


def _distance(mean: Column, precision: Column) -> Column:
    """The squared Mahalanobis distance of the row's vector."""
    off = [F.col(f) - mean[i] for i, f in enumerate(FEATURES)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        total = total + precision[k] * off[i] * off[j]
    return total


def _sums(units: list[Column]) -> list[Column]:
    """Exact sums of integers and of their products."""
    return [F.count("*").alias("n"), F.array(*map(F.sum, units)).alias("s"), F.array(*(F.sum(units[i] * units[j]) for i, j in _PAIRS)).alias("ss")]


def _moments(n: int, s: list[int], ss: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from exact sums."""
    cov = np.zeros((len(FEATURES), len(FEATURES)))
    for (i, j), q in zip(_PAIRS, ss, strict=True):
        cov[i, j] = cov[j, i] = (q * n - s[i] * s[j]) / (n * n)
    return np.array([x / n for x in s]), cov


def table_frame(rows: DataFrame) -> tuple[list[int], np.ndarray]:
    """Medians of the whole table's vectors, as integers, and their deviations, those from so many ``USUAL`` rows besides."""
    n, *middle = rows.agg(F.count("*"), *(F.percentile(f, 0.5) for f in FEATURES)).first()
    middle = [round(x or 0) for x in middle]
    spread = rows.agg(*(F.percentile(F.abs(F.col(f) - m), 0.5) for f, m in zip(FEATURES, middle, strict=True))).first()
    spread = 1.4826 * np.array([x or 0.0 for x in spread])
    return middle, np.sqrt((n * spread**2 + PRIOR_ROWS * (np.array(USUAL) * GRID) ** 2) / (n + PRIOR_ROWS))


#: A row a key, with an item for each of ``STARTS``; ``spread`` is the log determinant, null before the first step.
PARAMS = "key string, n long, starts array<struct<mean: array<double>, precision: array<double>, spread: double, settled: boolean>>"
_START = pa.struct([("mean", pa.list_(pa.float64())), ("precision", pa.list_(pa.float64())), ("spread", pa.float64()), ("settled", pa.bool_())])
_PARAMS = pa.schema([("key", pa.string()), ("n", pa.int64()), ("starts", pa.list_(_START))])


def _regular(n: float, mean: np.ndarray, cov: np.ndarray, spread: np.ndarray) -> dict:
    """The estimate from ``n`` rows and the prior ones, which lie around 0; the precision by rows of the triangle, off-diagonal doubled."""
    whole = (n * cov + PRIOR_ROWS * np.diag(spread**2) + n * PRIOR_ROWS / (n + PRIOR_ROWS) * np.outer(mean, mean)) / (n + PRIOR_ROWS)
    inverse = np.linalg.inv(whole)
    precision = [inverse[i, j] * (1 if i == j else 2) for i, j in _PAIRS]
    return {"mean": (n * mean / (n + PRIOR_ROWS)).tolist(), "precision": precision, "spread": float(np.linalg.slogdet(whole)[1])}


def _told(given: DataFrame, tell) -> DataFrame:
    """``PARAMS`` that ``tell`` makes of each row of ``given``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([{"key": r["key"], "n": r["n"], "starts": tell(r)} for r in batch.to_pylist()], _PARAMS)

    return given.mapInArrow(run, PARAMS)


def _starts(rows: DataFrame, total: int, table: np.ndarray) -> DataFrame:
    """``PARAMS`` before the first step."""
    groups = cut_lineage(rows.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.percentile(f, 0.5) for f in FEATURES)).alias("m")))
    off = [F.abs(F.col(f) - F.col("m")[i]) for i, f in enumerate(FEATURES)]
    spread = join_by(rows, groups, "key", "n", total).groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.percentile(o, 0.5) for o in off)).alias("d"))
    groups = cut_lineage(groups.join(spread.drop("n"), "key"))
    known = join_by(rows, groups.withColumn("size", F.col("n")), "key", "size", total)
    scale = [F.sqrt((F.col("n") * F.pow(1.4826 * F.col("d")[i], 2) + F.lit(PRIOR_ROWS * float(t) ** 2)) / (F.col("n") + PRIOR_ROWS)) for i, t in enumerate(table)]
    known = known.select("key", *(((F.col(f) - F.col("m")[i]) / scale[i]).alias(f) for i, f in enumerate(FEATURES)))
    norm = F.sqrt(sum((F.col(f) * F.col(f) for f in FEATURES), F.lit(0.0)))
    whole = lambda c, f: F.round(c * GRID).cast("long").alias(f)
    signs = F.struct(*(whole(F.when(F.col("norm") > 0, F.col(f) / F.col("norm") * math.sqrt(len(FEATURES))).otherwise(0.0), f) for f in FEATURES))
    bent = F.struct(*(whole(F.tanh(F.col(f)), f) for f in FEATURES))
    both = known.withColumn("norm", norm).select("key", F.posexplode(F.array(signs, bent)).alias("start", "z")).select("key", "start", "z.*")
    sums = both.groupBy("key", "start").agg(*_sums([F.col(f) for f in FEATURES]))
    shapes = sums.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "n", "s", "ss"))).alias("shapes"))

    def tell(r: dict) -> list[dict]:
        n, d = SHARE * r["n"], np.array(r["d"])
        own = np.sqrt((r["n"] * (1.4826 * d) ** 2 + PRIOR_ROWS * table**2) / (r["n"] + PRIOR_ROWS))
        shapes = [np.eye(len(FEATURES)), *(_moments(x["n"], x["s"], x["ss"])[1] / GRID**2 for x in r["shapes"])]
        return [_regular(n, np.array(r["m"]), own[:, None] * x * own[None, :], table) | {"spread": None, "settled": False} for x in shapes]

    return _told(groups.join(shapes, "key"), tell)


def _step(rows: DataFrame, params: DataFrame, total: int, table: np.ndarray) -> DataFrame:
    """``params`` after a concentration step from each; a start whose determinant falls no more stays as it is, settled."""
    near = join_by(rows, params.withColumn("size", F.col("n")), "key", "size", total).select("key", *FEATURES, F.posexplode("starts").alias("start", "p"))
    # squared distances in steps of an octave, so that a group's quantile needs a few hundred counts
    far = F.floor(F.log2(_distance(F.col("p.mean"), F.col("p.precision")) + 1) * STEPS_AN_OCTAVE).cast("int")
    cells = near.select("key", "start", far.alias("far"), *FEATURES).groupBy("key", "start", "far").agg(*_sums([F.col(f) for f in FEATURES]))
    cells = cells.groupBy("key").agg(F.collect_list(F.struct("start", "far", "n", "s", "ss")).alias("cells"))  # a few hundred a key

    def tell(r: dict) -> list[dict]:
        out = []
        for k, was in enumerate(r["starts"]):
            n, s, ss = 0, np.zeros(len(FEATURES), object), np.zeros(len(_PAIRS), object)
            for x in sorted((x for x in r["cells"] if x["start"] == k), key=lambda x: x["far"]):
                if n >= SHARE * r["n"]:
                    break
                n, s, ss = n + x["n"], s + np.array(x["s"], object), ss + np.array(x["ss"], object)
            mean, cov = _moments(n, list(s), list(ss))
            now = _regular(SHARE * r["n"], mean, cov * CONSISTENT, table)
            falls = was["spread"] is None or now["spread"] < was["spread"] - 1e-9
            out.append(now | {"settled": False} if falls else was | {"settled": True})
        return out

    return _told(params.join(cells, "key"), tell)


def fit(rows: DataFrame) -> DataFrame:
    """(key, n, mean, precision) of each key in rows (key, the vector), on the grid's scale."""
    middle, table = table_frame(rows)
    rows = cut_lineage(rows.select("key", *((F.col(f) - m).alias(f) for f, m in zip(FEATURES, middle, strict=True))))
    total = rows.count()
    going, ended = cut_lineage(_starts(rows, total, table)), []
    is_over = F.forall("starts", lambda x: x["settled"])
    while not going.isEmpty():
        after = cut_lineage(_step(rows, going, total, table))
        ended.append(after.where(is_over))
        going = after.where(~is_over)
    done = going
    for x in ended:
        done = done.unionByName(x)
    best = F.array_min(F.transform("starts", lambda x, i: F.struct(x["spread"].alias("spread"), i.alias("i"))))["i"]
    best = done.select("key", "n", F.element_at("starts", best + 1).alias("p"))
    return best.select("key", "n", F.array(*(F.col("p.mean")[i] + m for i, m in enumerate(middle))).alias("mean"), "p.precision")


def _key(lang_col: str, source_col: str) -> Column:
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return F.concat_ws("/", F.hex(text(lang_col)), F.hex(text(source_col))).alias("key")


def _estimates(rows: DataFrame) -> tuple[DataFrame, int]:
    """(key, n, mean, precision) for every key in rows (key, base_failed, the vector), and how many rows there are.

    n counts all rows of the key. A key none of whose rows pass has no estimate, and needs none.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    params = fit(rows.where(~F.col("base_failed"))).drop("n")
    known = cut_lineage(sizes.join(params, "key", "left").select("key", "n", "mean", "precision"))
    return known, known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _judged(df: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """``df`` (key, base_failed, the vector) with ``kept`` and ``distance``."""
    beyond = chi_square_quantile(CUTOFF, len(FEATURES))
    far = join_by(df, known, "key", "n", total).withColumn("distance", _distance(F.col("mean"), F.col("precision")))
    return far.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= beyond, F.lit(False))).drop("mean", "precision")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A null, empty or blank text has no words, so it fails the base rules. A null language or source is a value of its own; a null id
    stays null. A text of any length is read whole. Rows that tie at the cutoff are kept. Repeated rows count and are returned
    each; an empty table gives no rows; further columns, whatever their names, are left out.
    """
    rows = _with_counts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _key(lang_col, source_col)), "text")
    rows = cut_lineage(rows.select("id", "key", "_counts", _base_failed().alias("base_failed"), *_vector()))
    names = [F.col("_counts")[i].alias(name) for i, name in enumerate(COUNTS[:5])]
    return _judged(rows, *_estimates(rows)).select(F.col("id").alias(id_col), *names, "base_failed", "kept", "distance")


def keep(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with their columns. Texts are read twice; none of a heavy group is shuffled.

    Nulls, empty and long texts, ties, repeated rows and empty tables are treated as by ``judge``: a row with a null or empty
    text goes, repeats stay or go together, and columns of any name are kept as they are.
    """
    rows = _with_counts(df.select(F.col(text_col).alias("text"), _key(lang_col, source_col)), "text")
    rows = cut_lineage(rows.select("key", _base_failed().alias("base_failed"), *_vector()))
    known, total = _estimates(rows)
    # the rows pass through Python once; what is judged stands beside them under names of its own
    counts = free_name(df, "_counts")
    whole = _with_counts(df, text_col, counts).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), _key(lang_col, source_col), F.col(counts).alias("_counts"))
    judged = _judged(whole.select("row", "key", _base_failed().alias("base_failed"), *_vector()), known, total)
    return judged.where("kept").select("row.*")
