"""Token counts by a map-side two-tier lookup, and the chunk encoder that packing shares.

A text is cut at ASCII white space into *chunks*. The tokenizer never merges across white space (its normalizer
folds white space, its pre-tokenizer drops it, and no canonical composition crosses it), so the tokens of a text are
the tokens of its chunks in order, and a chunk's token count depends on the chunk alone. Special strings hold no white
space, so each lies inside one chunk, where the library treats it by its own default.

Tier one is a broadcast table of at most ``FREQUENT`` frequent chunks, found by a bounded sketch over all texts; it goes
out as one run of bytes with two arrays of numbers. Tier two is a bounded cache in each Python worker, filled by the library itself
from the chunks that tier one misses. No chunk is ever shuffled: a task sends one bounded sketch, and texts are counted where they
are read.

What is said of white space, case and stops holds for tokenizers that lower the case, drop white space and mark the ends of words. Of
any other, texts are encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planeweave.llm.common import bounded, utf8_column

#: Chunks in the broadcast table; with ``LONGEST`` bytes each at most, it stays under 3 MB.
FREQUENT = 16_384
#: Longer chunks are encoded each time and kept in neither tier.
LONGEST = 64
#: Entries of a worker's table before the later half of its second tier goes.
CACHE = 400_000
#: Texts whose chunks are looked up together.
TOGETHER = 256
#: Chunks joined in one string for the library.
JOINED = 50
#: Chunks whose pre-tokens are known: letters of Latin-1, then a run of marks or none. Each pre-token ends in a token with a word end.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")

#: Bytes of texts that ``chunks_of`` may cut finer: ASCII letters, digits and white space, stops, and letters of two bytes from xC3.
SIMPLE = bytes({*range(48, 58), *range(65, 91), *range(97, 123), *range(9, 14), 32, *b".,", 0xC3, *range(0x80, 0xC0)})

LATIN = bytes({*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)})

_loaded: dict[str, object] = {}
_tables: dict[tuple, ChunkTable] = {}


def tokenizer(path: str):
    """The tokenizer of ``path``, loaded once in a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def parts_at_space(path: str) -> bool:
    """Whether the tokenizer of ``path`` lowers the case, drops white space and marks the ends of words, so that ``chunks_of`` holds."""
    told = json.loads(tokenizer(path).to_str())
    steps = [told.get("normalizer") or {}, *((told.get("normalizer") or {}).get("normalizers") or [])]
    return any(x.get("type") == "Lowercase" for x in steps) and (told.get("model") or {}).get("end_of_word_suffix") == "</w>"


class Frequent:
    """Chunks and their token counts, packed for the way to the workers."""

    def __init__(self, counts: dict[bytes, int]):
        chunks = sorted(counts)
        self.bytes = b"".join(chunks)
        self.ends = np.cumsum([len(c) for c in chunks], dtype=np.uint32)
        self.counts = np.array([counts[c] for c in chunks], np.uint16)
        self.name = hash((self.bytes, self.counts.tobytes()))

    def table(self) -> dict[bytes, int]:
        ends = self.ends.tolist()
        return {self.bytes[a:b]: n for a, b, n in zip([0, *ends], ends, self.counts.tolist(), strict=False)}


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text: what white space parts, or finer where that gives the same tokens.

    In a text of nothing but ``SIMPLE`` bytes, in which no two stops meet, every stop is a pre-token of its own, and letters
    have no marks that could compose with them, so case may be folded first. That makes the chunks fewer.
    """
    if text.translate(None, SIMPLE) or b".." in text or b".," in text or b",." in text or b",," in text or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return text.split()
    return text.lower().replace(b",", b" , ").replace(b".", b" . ").split()


class ChunkTable:
    """Chunk to its ids (little-endian, four bytes each) or, with ``counts``, to their number; two tiers, looked up as one."""

    def __init__(self, path: str, counts: bool, frequent: Frequent | None = None, limit: int = CACHE):
        self.path, self.counts, self.limit = path, counts, limit
        self.table = frequent.table() if frequent else {}
        tok = tokenizer(path)
        self.by_chunk = parts_at_space(path)
        self.ends = np.zeros(tok.get_vocab_size(), bool)
        self.ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True

    def of(self, texts: list[bytes]) -> Iterator[list]:
        """The values of each text's chunks in order. What is missing is encoded for many texts at once."""
        if not self.by_chunk:
            for text in texts:
                yield list(self._each([text]).values())
            return
        for i in range(0, len(texts), TOGETHER):
            split = list(map(chunks_of, texts[i : i + TOGETHER]))
            if len(self.table) > self.limit:
                # what was met first is what comes often: the later half goes
                self.table = dict(islice(self.table.items(), self.limit // 2))
            get = self.table.get
            values = [list(map(get, chunks)) for chunks in split]
            holes = [[k for k, v in enumerate(found) if v is None] for found in values]
            fresh = self.encode(list({chunks[k] for chunks, missing in zip(split, holes, strict=True) for k in missing}))
            for chunks, found, missing in zip(split, values, holes, strict=True):
                for k in missing:
                    found[k] = fresh[chunks[k]]
                yield found
            self.table.update(fresh if max(map(len, fresh), default=0) <= LONGEST else {c: v for c, v in fresh.items() if len(c) <= LONGEST})

    def encode(self, chunks: list[bytes]) -> dict:
        """The values of ``chunks``. A plain chunk's is that of its letters in lower case and that of its stops together."""
        letters = [c for c in chunks if c.isalpha()]  # of bytes: ASCII letters only
        stopped, other = [], []
        for c in chunks:
            if not c.isalpha():
                if c.isascii():
                    m = PLAIN.fullmatch(c)
                    if m is not None:
                        stopped.append((c, m[1].lower(), m[2]))
                        continue
                elif not c.translate(None, LATIN) and (word := c.decode()).isalpha():
                    stopped.append((c, word.lower().encode(), b""))
                    continue
                elif (m := PLAIN.fullmatch(c)) is not None:
                    stopped.append((c, m[1].decode().lower().encode(), m[2]))
                    continue
                other.append(c)
        lower = list(map(bytes.lower, letters))
        wanted = set(lower).union([w for _, w, _ in stopped], [x for _, _, x in stopped if x]).difference(self.table)
        base = self._together(list(wanted)) if wanted else {}
        if base is None:  # a tokenizer of another kind
            return self._each(chunks)
        base.update((w, self.table[w]) for w in lower if w not in base)
        found = dict(zip(letters, map(base.__getitem__, lower), strict=True))
        for c, word, stops in stopped:
            value = base[word] if word in base else self.table[word]
            found[c] = value + (base[stops] if stops in base else self.table[stops]) if stops else value
        return found | self._each(other) if other else found

    def _together(self, plain: list[bytes]) -> dict | None:
        """The values of chunks that are one pre-token each, by calls for many; None if word ends don't tell them apart."""
        encoded = tokenizer(self.path).encode_batch_fast([b" ".join(plain[i : i + JOINED]).decode() for i in range(0, len(plain), JOINED)], add_special_tokens=False)
        ids = np.array(list(chain.from_iterable(e.ids for e in encoded)), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(plain):
            return None
        cuts = [0, *ends.tolist()]
        if self.counts:
            return dict(zip(plain, np.diff(cuts).tolist(), strict=True))
        raw = ids.tobytes()
        return {c: raw[4 * i : 4 * j] for c, i, j in zip(plain, cuts, cuts[1:], strict=False)}

    def _each(self, chunks: list[bytes]) -> dict:
        encoded = tokenizer(self.path).encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return {c: len(e.ids) if self.counts else np.array(e.ids, "<u4").tobytes() for c, e in zip(chunks, encoded, strict=True)}


def chunk_table(path: str, counts: bool, frequent: Frequent | None = None) -> ChunkTable:
    """The worker's table for this use, the only one it holds; it outlives a task."""
    name = (path, counts, frequent.name if frequent else None)
    if name not in _tables:
        _tables.clear()
        _tables[name] = ChunkTable(path, counts, frequent)
    return _tables[name]


def _sketch(batches: Iterable[pa.RecordBatch], text_col: str, size: int) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in bounded(batches, text_col):
        for text in utf8_column(batch, text_col):
            seen.update(chunks_of(text))  # as they are looked up
            if len(seen) > 8 * size:
                seen = Counter(_top(seen, 4 * size))
    kept = [x for x in _top(seen, 2 * size).items() if len(x[0]) <= LONGEST][:size]
    yield pa.record_batch({"chunks": pa.array([[c for c, _ in kept]], pa.list_(pa.binary())), "counts": pa.array([[n for _, n in kept]], pa.list_(pa.int64()))})


def _top(counts: dict, size: int) -> dict:
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])


def frequent_chunks(df: DataFrame, text_col: str = "text", size: int = FREQUENT) -> list[bytes]:
    """At most ``size`` frequent chunks of all texts. One bounded sketch a task, merged in a tree; no chunk is shuffled."""

    def merged(a: dict, b: dict) -> dict:
        both = Counter(a)
        both.update(b)
        return _top(both, size)

    sketches = df.select(F.col(text_col)).mapInArrow(lambda it: _sketch(it, text_col, size), "chunks array<binary>, counts array<bigint>")
    rdd = sketches.rdd.map(lambda r: dict(zip(map(bytes, r.chunks), r.counts, strict=True)))
    return list(rdd.treeReduce(merged, depth=3)) if rdd.getNumPartitions() else []


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, frequent: int = FREQUENT) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``), as the library's tokenizer counts.

    A null text counts as empty (0 bytes, 0 tokens), and a null id stays null. Repeated rows are counted each; an empty table gives no
    rows; further columns, whatever their names, are left out. Texts of any length are counted whole. ``path`` is a file of the
    tokenizers library.
    """
    top = frequent_chunks(df, text_col, frequent) if parts_at_space(path) else []
    known = ChunkTable(path, counts=True).encode(top) if top else {}
    shared = df.sparkSession.sparkContext.broadcast(Frequent(known))
    out = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(path, True, shared.value)
        for batch in bounded(batches, text_col):
            texts = utf8_column(batch, text_col)
            tokens = list(map(sum, table.of(texts)))
            yield pa.record_batch([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], schema=out)

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(counted, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean")
