"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what they miss.

A candidate is a run of secret-like characters that follows a sensitive word closely; of a run that holds such words itself, what
comes after the first of them, or else after the last. Its novelty is the number of
bytes by which the compressed code around it, without further copies of the candidate, grows when the candidate is put in,
zstandard being primed with a dictionary of common identifiers. Names, paths and prose repeat the dictionary or the code around them and cost little; a key
costs nearly its length. Each text is scanned whole, in the task that reads it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planeweave.llm.common import bounded

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of [0-9a-f] is a match of this if it has 16 or more
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words after which a secret may stand within ``REACH`` characters.
SENSITIVE = re.compile(r"passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|authorization|auth[_-]?key|signing[_-]?key|client[_-]?id|session[_-]?id", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]*+")
REACH, AROUND = 48, 256
#: Share of a candidate's length, and bytes, that it must add to the compressed code.
NOVELTY, LEAST = 0.6, 10
#: What the dictionary is made of: names that code and prose about code hold often.
IDENTIFIERS = """
password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret
session_id authorization bearer credential username user_name user_id email address account config configuration settings
environment default_value get_token set_password os.environ getenv process.env request response headers content_type
application/json text/html utf-8 http:// https:// www. .com .org .net .example /usr/local/bin /etc/ /var/log/ /home/user/
import from return function class public private static final const string integer boolean double float null none true false
self.__init__ this. def async await print logger.info logger.error raise except exception error message value key name type
path file filename directory index.html main.py package.json requirements.txt README LICENSE version description
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 your_token_here changeme example placeholder xxxxxxxxxxxxxxxx
0000000000000000 1234567890 test_value sample_key
"""
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, rank of the kind, end) of the contract's patterns, by start and kind."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, start after the last sensitive word inside, end) of runs near sensitive words, in order; none overlap.

    Each run is read once, and after a word no further than ``REACH``, so this takes a time linear in the text.
    """
    found: list[list[int]] = []
    end = 0  # of the last run
    for word in SENSITIVE.finditer(text):
        if word.end() <= end:
            found[-1][1] = word.end()
        at = max(word.end(), end)
        while (m := CANDIDATE.search(text, at, word.end() + REACH + 16)) is not None:
            at = end = RUN.match(text, m.end()).end()
            found.append([m.start(), m.start(), end])
    return [tuple(x) for x in found]


class Novelty:
    """The marginal compressed size of strings in their surroundings."""

    def __init__(self):
        known = zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS.split()).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False)

    def marginal(self, text: str, start: int, end: int) -> int:
        body = text[start:end]
        # copies that reach over the edge of the surroundings are whole in these
        before, after = text[max(0, start - AROUND - len(body)) : start], text[end : end + AROUND + len(body)]
        for x in {body, *(x for x in body.split("=") if len(x) >= 16)}:  # a copy of a secret tells nothing about its novelty
            before, after = before.replace(x, " "), after.replace(x, " ")
        head, tail = before[-AROUND:].encode(), after[:AROUND].encode()
        return len(self.press.compress(head + body.encode() + tail)) - len(self.press.compress(head + tail))

    def spans(self, text: str, taken: list[Span]) -> list[Span]:
        """Candidates in sensitive context that are novel and touch no span in ``taken``."""
        found = candidates(text)
        kept: list[Span] = []
        starts = [s for s, _, _ in taken]
        reach = list(accumulate((e for _, _, e in taken), max))  # how far the spans up to each go
        for start, later, end in found:
            before = bisect_left(starts, end)
            for at in {start: 0, later: 0} if later + 16 <= end else (start,):
                if before and reach[before - 1] > at:
                    continue
                grown = self.marginal(text, at, end)
                if grown >= LEAST and grown >= NOVELTY * (end - at):
                    kept.append((at, 3, end))
                    break
        return kept


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points, end exclusive).

    A null, empty or blank text has no spans; a null id stays null. A text of any length is scanned whole, in a time linear in it. Of
    spans that begin together the kinds' order decides. Repeated rows are returned each; an empty table gives no rows; further
    columns, whatever their names, are left out.
    """
    out = pa.schema([(id_col, pa.int64()), *((n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in bounded(batches, text_col):
            columns: list[list] = [[] for _ in range(5)]
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + novelty.spans(text or "", base))
                kinds = [k for _, k, _ in base]
                for column, value in zip(columns, (*(kinds.count(k) for k in range(3)), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans)), strict=True):
                    column.append(value)
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True))], schema=out)

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``df`` with every secret in ``text_col`` replaced by ``mark``; all rows and columns stay. A null text stays null.

    ``length_col``, where there is such a column, gets the new text's length in code points; null stays null. An empty text and one of
    any length are treated alike, spans that overlap become one mark, repeated rows are redacted each, an empty table stays empty, and
    columns of any name are kept as they are.
    """

    def clean(text: str | None, novelty: Novelty) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted(base + novelty.spans(text, base))
        out, at = [], 0
        for s, _, e in spans:
            if s >= at:
                out += [text[at:s], mark]
            at = max(at, e)
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in bounded(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            texts = [clean(t, novelty) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    found = df.mapInArrow(run, T.StructType(df.schema.fields))
    if length_col in df.columns:
        kind = df.schema[length_col].dataType
        found = found.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.coalesce(F.char_length(text_col).cast(kind), F.col(length_col))))
    return found
