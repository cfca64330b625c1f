"""Page rows to the frames table and the event tables.

Every operator takes DataFrames and column names and returns a lazy DataFrame. Keys (``by``) come first in every grouping, so a
shuffle is on the recording, and volume starts are a partial aggregate that is joined back, not a sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions import layout, parse
from planeweave.operators import timeline
from planeweave.schema import EVENT_KEYS, PAGE_KEYS


def with_page_map(df: DataFrame, page: str, n_channels, kept, per_slice, on_disk) -> DataFrame:
    """``df`` with the page's place in its volume."""
    return df.withColumns(layout.page_map(F.col(page), n_channels, kept, per_slice, on_disk))


def page_window(df: DataFrame, page: str, start: int = 0, stop: int = -1) -> DataFrame:
    """Pages from ``start`` to before ``stop``; a negative stop takes all."""
    found = df.where(F.col(page) >= start)
    return found if stop < 0 else found.where(F.col(page) < stop)


def complete_volumes(df: DataFrame, page: str, pages_per_volume: int, n_pages: int, limit: int = 0) -> DataFrame:
    """Pages of whole volumes, of the first ``limit`` if that is not 0."""
    n = n_pages // pages_per_volume
    n = min(n, limit) if limit else n
    return df.where(F.col(page) < n * pages_per_volume)


def volume_starts(df: DataFrame, volume: Sequence[str], page: str, time: str, name: str = "volume_timestamp") -> DataFrame:
    """One row a volume: the time of its first page, even if that is NaN."""
    return df.groupBy(*volume).agg(F.min_by(time, page).alias(name))


def with_volume_time(df: DataFrame, volume: Sequence[str], page: str, time: str, name: str = "volume_timestamp") -> DataFrame:
    """``df`` with its volume's start time."""
    return df.join(volume_starts(df, volume, page, time, name), list(volume))


def first_channel(df: DataFrame, channel: str, by: Sequence[str]) -> DataFrame:
    """Rows of the least channel that is there, in each group of ``by``; of all rows if there is none."""
    if not by:
        least = df.agg(F.min(channel).alias("_least"))
        return df.join(F.broadcast(least), F.col(channel) == F.col("_least"), "left_semi")  # one row
    least = df.groupBy(*by).agg(F.min(channel).alias(channel))
    return df.join(least, [*by, channel], "left_semi")


def frames(pages: DataFrame, n_channels, kept, per_slice, on_disk, by: Sequence[str] = (), keep_entries: bool = False) -> DataFrame:
    """The frames table from pages (page_index, file_index, file_page_index, description).

    volume_index and volume_timestamp_s count within a file, as ``file_page_index`` does; without that column files are
    taken to begin at page_index.
    """
    local = "file_page_index" if "file_page_index" in pages.columns else "page_index"
    rows = pages.withColumn("_entries", parse.description(F.col("description")))
    # later entries count, so these are searched from the end
    rows = rows.withColumns({"_keys": F.reverse(F.transform("_entries", lambda x: x["k"])), "_values": F.reverse(F.transform("_entries", lambda x: x["v"]))})
    value = lambda key: F.try_element_at("_values", F.nullif(F.array_position("_keys", key), F.lit(0)).cast("int"))
    rows = with_page_map(rows, local, n_channels, kept, per_slice, on_disk)
    ints = {"frameNumbers": "bigint", "acquisitionNumbers": "int", "frameNumberAcquisition": "bigint", "endOfAcquisition": "tinyint", "endOfAcquisitionMode": "tinyint", "dcOverVoltage": "tinyint"}
    made = {PAGE_KEYS[k]: parse.to_int(value(k), -1, t) for k, t in ints.items()}
    made |= {PAGE_KEYS[k]: parse.to_float(value(k)) for k in ("frameTimestamps_sec", "acqTriggerTimestamps_sec", "nextFileMarkerTimestamps_sec")}
    made |= {f"n_aux{i}": F.size(parse.numeric_array(value(f"auxTrigger{i}"))).cast("smallint") for i in range(4)}
    made["n_i2c"] = F.size(parse.i2c_packets(value("I2CData"))).cast("smallint")
    rows = rows.withColumns(made)
    if "file_index" not in rows.columns:
        rows = rows.withColumn("file_index", F.lit(0))
    rows = rows.withColumn("file_index", F.col("file_index").cast("smallint"))
    volume = [*by, "file_index", "volume_index"]
    if n_channels == on_disk == 1 and isinstance(on_disk, int):  # every page is a volume of its own
        rows = rows.withColumn("volume_timestamp_s", F.col("frame_timestamp_s"))
        return rows.select(*_frame_columns(by), *(["_entries"] if keep_entries else []))
    starts = volume_starts(rows, volume, "page_index", "frame_timestamp_s", "volume_timestamp_s")
    return rows.join(starts, volume).select(*_frame_columns(by), *(["_entries"] if keep_entries else []))


def _frame_columns(by: Sequence[str]) -> list[str]:
    return [*by, "page_index", *(c for c in PAGE_KEYS.values() if c), "channel", "slice_index", "frame_repeat_index", "volume_index", "volume_timestamp_s", "is_flyback", "n_aux0", "n_aux1", "n_aux2", "n_aux3", "n_i2c", "file_index"]


def context() -> list[Column]:
    """What an event takes from its frame."""
    return [F.col(c) for c in ("page_index", "frame_number", "frame_timestamp_s", "volume_index", "volume_timestamp_s", "slice_index", "channel", "file_index")]


def place_events(df: DataFrame, time: str = "timestamp_s", frame_time: str = "frame_timestamp_s", volume_time: str = "volume_timestamp_s") -> DataFrame:
    """``df`` with each event's offset in its frame and its volume; either may be slightly negative."""
    return df.withColumns({"offset_in_frame_s": F.col(time) - F.col(frame_time), "offset_in_volume_s": F.col(time) - F.col(volume_time)})


def aux_events(framed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a trigger, in page and header order, from frames with their entries. Empty fields are skipped unparsed."""
    lines = F.array(*(F.struct(F.lit(i).alias("aux_line"), parse.lookup(F.col("_entries"), f"auxTrigger{i}").alias("text")) for i in range(4)))
    filled = F.filter(lines, lambda x: x["text"].isNotNull() & ~parse.strip(x["text"]).isin("[]", ""))
    rows = framed.select(*by, *context(), F.explode(filled).alias("l"))
    rows = rows.select(*by, *context(), F.col("l.aux_line").alias("aux_line"), F.posexplode(parse.aux_trigger(F.col("l.text"))).alias("event_pos", "timestamp_s"))
    return place_events(rows)


def i2c_events(framed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row a bus packet, valid or not."""
    text = parse.lookup(F.col("_entries"), "I2CData")
    rows = framed.where(text.isNotNull() & ~parse.strip(text).isin("{}", "")).select(*by, *context(), F.posexplode(parse.i2c_packets(text)).alias("event_pos", "packet"))
    rows = rows.withColumns({"timestamp_s": F.col("packet.timestamp_s"), "payload_kind": F.col("packet.payload_kind"), "payload_length": parse.payload_length(F.col("packet")), "valid": parse.is_valid_time(F.col("packet.timestamp_s"))})
    return place_events(rows)


# --- key sets of page headers -------------------------------------------------------------------------------


def signatures(df: DataFrame, text: str, page: str, by: Sequence[str] = ()) -> DataFrame:
    """``df``'s keys and page with ``signature``: its header keys in order."""
    return df.select(*by, F.col(page), parse.keys_of(parse.description(F.col(text))).alias("signature"))


def signature_counts(sigs: DataFrame, page: str, by: Sequence[str] = ()) -> DataFrame:
    """A row for each signature: pages, its first page, and its number by first appearance."""
    found = sigs.groupBy(*by, "signature").agg(F.count("*").alias("n_pages"), F.min(page).alias("first_page"))
    # no two begin on one page
    numbered = timeline.running_count(found, by, ["first_page"], "signature_id") if by else timeline.running_count(found.withColumn("_one", F.lit(1)), ["_one"], ["first_page"], "signature_id").drop("_one")
    return numbered.select(*found.columns, (F.col("signature_id") - 1).cast("int").alias("signature_id"))


def reference_signature(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The longest signature, of the same length the one that comes first."""
    best = F.max_by("signature", F.struct(F.size("signature"), -F.col("first_page"))).alias("reference")
    return counts.groupBy(*by).agg(best) if by else counts.agg(best)


def truncated(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signatures that are a strict beginning of the reference, with the keys that they lost."""
    ref = reference_signature(counts, by)
    rows = counts.join(ref, list(by)) if by else counts.crossJoin(ref)  # one row
    cut = (F.size("signature") < F.size("reference")) & (F.slice("reference", F.lit(1), F.greatest(F.size("signature"), F.lit(0))) == F.col("signature"))
    lost = F.array_except("reference", "signature")
    return rows.where(cut).withColumns({"lost": lost, "lost_events": F.array_intersect(lost, F.array(*map(F.lit, EVENT_KEYS)))})


def unknown_keys(df: DataFrame, text: str, page: str, by: Sequence[str] = (), known: Sequence[str] = tuple(PAGE_KEYS)) -> DataFrame:
    """Keys that are not known, with the first page that has each, its value there, and the pages that have it."""
    rows = df.select(*by, F.col(page).alias("page"), F.posexplode(parse.description(F.col(text))).alias("pos", "e"))
    rows = rows.where(~F.col("e.k").isin(*known) & (F.col("e.k") != ""))
    return rows.groupBy(*by, F.col("e.k").alias("key")).agg(F.min("page").alias("first_page"), F.min_by("e.v", F.struct("page", -F.col("pos"))).alias("value"), F.countDistinct("page").alias("n_pages"))
