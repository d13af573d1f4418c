"""Record schemas: declared, never inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType, TimestampType


def _of(**columns) -> StructType:
    return StructType([StructField(k, v) for k, v in columns.items()])


S, B, D, I, TS = StringType(), BooleanType(), DoubleType(), IntegerType(), TimestampType()
MANIFEST = _of(record=S, asset_type=S, url=S, canonical=S, html_path=S, html_path_abs=S, path=S, page=S, alt=S, src_hint=S, ts=TS)
DOCUMENT = _of(
    id=S, source_url=S, source_type=S, text_full=S, content_hash=S, captured_at=TS, title=S, published_at=S, updated_at=S,
    is_infographic=B, alt=S, page=S, ocr_avg_conf=D, ocr_text_area_ratio=D, format=S, has_tables=B, text=S,
)
CHUNK = _of(id=S, parent_id=S, source_url=S, source_type=S, profile=S, chunk_index=I, chunk_total=I, n_tokens=I, text=S, metadata=S)
URL = _of(url=S)
EMBEDDABLE = _of(id=S, text=S, metadata=URL)
VECTOR = _of(id=S, text=S, metadata=URL, embedding=ArrayType(FloatType()))
POINT = _of(x=D, y=D)
OCR_BOX = _of(poly=ArrayType(POINT), text=S, conf=D)
OCR = _of(img_h=I, img_w=I, boxes=ArrayType(OCR_BOX))
FETCHED = _of(url=S, status=I, content_type=S, body=S)
