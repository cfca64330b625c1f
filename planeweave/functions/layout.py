"""Page numbers to places in the recording, by integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a - a % b, b).cast("bigint")


def page_map(page: Column, n_channels: Column | int, kept: Column | int, per_slice: Column | int, on_disk: Column | int) -> dict[str, Column]:
    """volume_index, channel, slice_index, frame_repeat_index and is_flyback of a page.

    The channel varies fastest, then the repeats of a slice, then slices; frames beyond ``kept`` are flyback, whose
    slice and repeat are -1.
    """
    nch, kept, fps, disk = (x if isinstance(x, Column) else F.lit(int(x)).cast("bigint") for x in (n_channels, kept, per_slice, on_disk))
    page = page.cast("bigint")
    within = page % (disk * nch)
    raw = _div(within, nch)
    fly = raw >= kept
    return {
        "volume_index": _div(page, disk * nch),
        "channel": (within % nch).cast("smallint"),
        "slice_index": F.when(fly, F.lit(-1)).otherwise(_div(raw, fps)).cast("smallint"),
        "frame_repeat_index": F.when(fly, F.lit(-1)).otherwise(raw % fps).cast("smallint"),
        "is_flyback": fly,
    }


def page_offsets(planes: list[int], n_channels: int, per_slice: int, channel: int = 0) -> list[list[int]]:
    """Where in a volume the pages of ``planes`` lie for a channel: a row for each plane, an item for each repeat."""
    return [[(p * per_slice + r) * n_channels + channel for r in range(per_slice)] for p in planes]
