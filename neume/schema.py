"""Types of the engine's tables.  Every table carries ``doc_id`` and an explicit ``seq``."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])
_KEY = [T.StructField("doc_id", T.StringType()), T.StructField("seq", T.IntegerType())]


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(_KEY + [T.StructField(n, t) for n, t in fields])


_S, _I, _D, _B = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TOKENS = _table(("text_raw", _S), ("text_norm", _S), ("bbox", BBOX), ("confidence", _D), ("system_index", _I))
SYSTEMS = _table(("bbox", BBOX), ("y_center", _D))
BARLINES = _table(("bbox", BBOX), ("center_x", _D))
CHART_TOKENS = _table(("text", _S), ("bbox", BBOX), ("confidence", _D), ("source", _S), ("row_index", _I), ("col_index", _I), ("measure_index", _I), ("region", _S))
SYMBOLS = _table(("voice", _I), ("rhythm", _S), ("pitch", _S), ("lift", _S), ("articulation", _S), ("position", _S))
CANDIDATES = _table(("group_id", _S), ("source", _S), ("text_raw", _S), ("text_norm", _S), ("bbox", BBOX), ("confidence", _D), ("current_hybrid_applied", _B), ("eligible", _B), ("system_index", _I))
JOBS = T.StructType([T.StructField(n, _S) for n in ("job_id", "status", "message", "stage", "musicxml_path", "chord_assignments_path", "chord_chart_path", "callback_url", "error", "callback_error")] + [T.StructField(n, _I) for n in ("progress", "current_step", "total_steps")] + [T.StructField("updated_at", T.TimestampType())])
#: An exact duration; equal fractions are equal structs because they are reduced.
RATIONAL = T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())])

_JSON_BOX = T.ArrayType(_D)
GEOMETRY_JSON = T.StructType(
    [
        T.StructField("coordinate_space", _S),
        T.StructField("image", T.StructType([T.StructField("width", _I), T.StructField("height", _I)])),
        T.StructField("systems", T.ArrayType(T.StructType([T.StructField("index", _I), T.StructField("bbox", _JSON_BOX), T.StructField("staffs", T.ArrayType(T.StructType([T.StructField("index", _I), T.StructField("bbox", _JSON_BOX), T.StructField("average_unit_size", _D)])))]))),
        T.StructField("barlines", T.ArrayType(T.StructType([T.StructField("bbox", _JSON_BOX), T.StructField("center", _JSON_BOX), T.StructField("angle", _D)]))),
        T.StructField("_corrupt_record", _S),
    ]
)
