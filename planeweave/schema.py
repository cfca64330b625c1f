"""The engine's contracts: the schemas of its tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType, "INT": T.IntegerType, "SMALLINT": T.ShortType, "TINYINT": T.ByteType, "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType, "STRING": T.StringType}


def _fields(text: str) -> T.StructType:
    """A schema of plain types from ``name TYPE, ...``; unlike Spark's own parser, it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in (x.split() for x in text.split(", "))])


FRAMES = _fields(
    "page_index BIGINT, frame_number BIGINT, acquisition_number INT, frame_number_acquisition BIGINT, "
    "frame_timestamp_s DOUBLE, acq_trigger_timestamp_s DOUBLE, next_file_marker_timestamp_s DOUBLE, "
    "end_of_acquisition TINYINT, end_of_acquisition_mode TINYINT, dc_over_voltage TINYINT, "
    "channel SMALLINT, slice_index SMALLINT, frame_repeat_index SMALLINT, volume_index BIGINT, "
    "volume_timestamp_s DOUBLE, is_flyback BOOLEAN, n_aux0 SMALLINT, n_aux1 SMALLINT, n_aux2 SMALLINT, "
    "n_aux3 SMALLINT, n_i2c SMALLINT, file_index SMALLINT"
)
AUX = _fields(
    "aux_line INT, timestamp_s DOUBLE, page_index BIGINT, frame_number BIGINT, frame_timestamp_s DOUBLE, "
    "offset_in_frame_s DOUBLE, volume_index BIGINT, volume_timestamp_s DOUBLE, offset_in_volume_s DOUBLE, "
    "slice_index SMALLINT, channel SMALLINT, file_index SMALLINT, event_pos INT"
)
CALIBRATION = _fields(
    "zoom DOUBLE, px_to_micron_x DOUBLE, px_to_micron_y DOUBLE, micron_to_px_x DOUBLE, micron_to_px_y DOUBLE, "
    "resolution_px_x INT, resolution_px_y INT, n_peaks_x INT, n_peaks_y INT"
)
PAGES = _fields("file STRING, file_index INT, page_index BIGINT, description STRING")
PIXELS = _fields("file STRING, file_index INT, page_index BIGINT, height INT, width INT, dtype STRING").add("pixels", T.ArrayType(T.DoubleType()))
#: Page-header keys that every page carries, in their order, and the column each fills. Fixed values of the file format.
PAGE_KEYS = {
    "frameNumbers": "frame_number",
    "acquisitionNumbers": "acquisition_number",
    "frameNumberAcquisition": "frame_number_acquisition",
    "frameTimestamps_sec": "frame_timestamp_s",
    "acqTriggerTimestamps_sec": "acq_trigger_timestamp_s",
    "nextFileMarkerTimestamps_sec": "next_file_marker_timestamp_s",
    "endOfAcquisition": "end_of_acquisition",
    "endOfAcquisitionMode": "end_of_acquisition_mode",
    "dcOverVoltage": "dc_over_voltage",
    "epoch": None,
    "auxTrigger0": None,
    "auxTrigger1": None,
    "auxTrigger2": None,
    "auxTrigger3": None,
    "I2CData": None,
}
EVENT_KEYS = ("auxTrigger0", "auxTrigger1", "auxTrigger2", "auxTrigger3", "I2CData")
