"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each partition is packed where it is read: there is no shuffle, the pool of waiting examples is bounded, and a rerun of a
lost task packs the same rows in the same way. A sequence is filled by the dot-product heuristic: of the examples
that fit, the one whose demand vector has the largest product with the vector of room left, each divided by its
limit and weighted by the pool's mean demand. When none fits, the example of the largest product is cut to fill
the rest, so sequences end full. A sequence that can't be filled (the segment or loss limit is reached, or
the partition ends) is dealt out again into sequences whose lengths are powers of two and need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import bounded, utf8_column
from planeweave.llm.tokens import chunk_table

#: Examples that wait in a task to be placed.
POOL = 512
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padded_length long"


@dataclass
class Example:
    """What is left of a document: its ids from ``start`` on. loss: running counts of loss-bearing ids, or None if all are."""

    key: tuple
    ids: bytes
    total: int
    start: int = 0
    loss: np.ndarray | None = None

    @property
    def length(self) -> int:
        return self.total - self.start

    def loss_of(self, start: int, length: int) -> int:
        return length if self.loss is None else int(self.loss[start + length] - self.loss[start])

    def longest(self, tokens: int, loss: int) -> int:
        """Ids from ``start`` on that fit."""
        most = min(self.length, tokens)
        if self.loss is None:
            return min(most, loss)
        end = int(np.searchsorted(self.loss, self.loss[self.start] + loss, side="right")) - 1
        return min(most, end - self.start)


@dataclass
class Packer:
    """Packs examples as they come; ``pieces`` holds what is placed: key, start, length, crc, total, sequence, offset, loss, padded."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    first: int = 0
    pool: int = POOL
    pieces: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")
        self.waiting: list[Example] = []
        self.demand = np.zeros((self.pool + 1, 3))
        self.next = self.first

    def add(self, example: Example) -> None:
        while example.length > self.tokens and (n := example.longest(self.tokens, self.loss)) == self.tokens:
            self._close([(example, example.start, n)])
            example.start += n
        if example.length:
            self._wait(example)
        if len(self.waiting) >= self.pool:
            self._fill()

    def finish(self) -> None:
        while self.waiting:
            self._fill()

    def _wait(self, x: Example) -> None:
        self.demand[len(self.waiting)] = x.length, 1, x.loss_of(x.start, x.length)
        self.waiting.append(x)

    def _drop(self, i: int) -> Example:
        x, last = self.waiting[i], self.waiting.pop()
        if i < len(self.waiting):
            self.waiting[i], self.demand[i] = last, self.demand[len(self.waiting)]
        return x

    def _fill(self) -> None:
        limits, used = np.array([self.tokens, self.segments, self.loss], float), []
        room = limits.copy()
        weight = self.demand[: len(self.waiting)].mean(axis=0) / limits**2
        while self.waiting and room[0] >= 1 and room[1] >= 1:
            demand = self.demand[: len(self.waiting)]
            product = demand @ (weight * room / limits)
            fits = (demand <= room).all(axis=1)
            if fits.any():
                x = self._drop(int(np.argmax(np.where(fits, product, -1.0))))
                used.append((x, x.start, x.length))
            else:
                # the longest head that fits, tried from the largest product on
                for i in np.argsort(-product, kind="stable"):
                    x = self.waiting[i]
                    if n := x.longest(int(room[0]), int(room[2])):
                        break
                else:
                    break
                used.append((x, x.start, n))
                x.start += n
                self.demand[i] = x.length, 1, x.loss_of(x.start, x.length)
            x, start, n = used[-1]
            room -= n, 1, x.loss_of(start, n)
        self._close(used)

    def _close(self, used: list[tuple[Example, int, int]]) -> None:
        left = sum(n for _, _, n in used)
        while left:
            size = min(self.tokens, left) if left >= self.tokens else 1 << (left.bit_length() - 1)
            offset = 0
            while offset < size:
                x, start, n = used[0]
                take = min(n, size - offset)
                crc = zlib.crc32(memoryview(x.ids)[4 * start : 4 * (start + take)])
                self.pieces.append((x.key, start, take, crc, x.total, self.next, offset, x.loss_of(start, take), size))
                used = [(x, start + take, n - take), *used[1:]] if take < n else used[1:]
                offset += take
            self.next += 1
            left -= size


def pack(df: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", loss_col: Column | None = None, turns: Column | None = None, tokens: int = 4096, segments: int = 256, loss: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pack every row of ``df`` into sequences of at most ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing ids.

    A row's ids are those of its text followed by ``end_id``; all bear loss, or with ``loss_col``, a boolean, those of the rows where it
    is true. For instruction data in one row, ``turns`` is an array of struct<text string, loss boolean>: the ids of each
    turn's text in order, loss-bearing where the turn says so; the end id counts with the last turn. One row is returned for
    each piece, with ``id_col`` and the further whole numbers ``keys`` of its row; ``padded_length`` is its sequence's length, a power
    of two or ``tokens``.

    A null text, null array, null turn or null flag counts as empty or not loss-bearing, so such a row is its end id alone; a null id
    stays null. A text of any length is cut into as many sequences as it needs. Of examples that fit equally well the one that waits
    first is taken. Repeated rows are packed each; an empty table gives no rows; further columns, whatever their names, are left out.
    """
    names = [id_col, *keys]
    out = pa.schema([(name, pa.int64()) for name in (*names, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "padded_length")])
    end, whole = np.array([end_id], "<u4").tobytes(), turns is None

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path, False)
        packer = Packer(tokens, segments, tokens if loss is None else loss, first=TaskContext.get().partitionId() << 36)

        def given() -> pa.RecordBatch:
            columns = list(zip(*((*key, *rest) for key, *rest in packer.pieces), strict=True)) or [[]] * len(out)
            packer.pieces = []
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=out)

        for batch in bounded(batches, "text"):
            ids_of = list(zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True))
            if whole:
                flags = batch.column(len(names) + 1).to_pylist()
                for key, flag, values in zip(ids_of, flags, table.of(utf8_column(batch, "text")), strict=True):
                    ids = b"".join(values) + end
                    n = len(ids) // 4
                    packer.add(Example(key, ids, n, loss=None if flag else np.zeros(n + 1, np.int64)))
                    if len(packer.pieces) > 8192:
                        yield given()
            else:
                rows = [[((t or {}).get("text") or "", bool((t or {}).get("loss"))) for t in parts or []] for parts in batch.column(len(names) + 1).to_pylist()]
                values = table.of([text.encode() for parts in rows for text, _ in parts])
                for key, parts in zip(ids_of, rows, strict=True):
                    spans = [(b"".join(next(values)), flag) for _, flag in parts]
                    flags = [np.full(len(b) // 4, f) for b, f in spans] + [np.array([spans[-1][1] if spans else False])]
                    ids = b"".join(b for b, _ in spans) + end
                    packer.add(Example(key, ids, len(ids) // 4, loss=np.concatenate([[0], np.cumsum(np.concatenate(flags))])))
                    if len(packer.pieces) > 8192:
                        yield given()
        packer.finish()
        yield given()

    columns = [F.col(name).cast("long").alias(name) for name in names]
    if whole:
        rest = [F.col(text_col).alias("text"), F.lit(True).alias("bears") if loss_col is None else F.coalesce(loss_col, F.lit(False)).alias("bears")]
    else:
        # the texts of the turns once more, by whose bytes batches are bounded
        rest = [F.array_join(F.transform(turns, lambda t: t["text"]), "").alias("text"), turns.alias("turns")]
    return df.select(*columns, *rest).mapInArrow(packed, "".join(f"{name} long, " for name in names) + PIECES)
