"""Fixed schemas of the catalog tables. Timestamps are naive UTC."""

from pyspark.sql import types as T

_LONG, _INT, _STR, _BOOL, _DBL, _TS = (
    T.LongType(),
    T.IntegerType(),
    T.StringType(),
    T.BooleanType(),
    T.DoubleType(),
    T.TimestampNTZType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CATALOG: dict[str, T.StructType] = {
    "users": _schema(
        id=_LONG, google_id=_STR, email=_STR, display_name=_STR, role=_STR, ab_test_access=_BOOL
    ),
    "books": _schema(
        id=_LONG, title=_STR, author=_STR, filename=_STR, pdf_path=_STR, status=_STR, hidden=_BOOL,
        page_count=_INT, genre=_STR, year=_INT, notes=_STR, tts_narrator=_STR, tts_instructions=_STR,
        uploaded_by=_LONG, created_at=_TS,
    ),
    "segments": _schema(
        id=_LONG, book_id=_LONG, seg_order=_INT, text=_STR, chapter_title=_STR, audio_path=_STR,
        status=_STR, duration=_DBL,
    ),
    "segment_audio": _schema(
        id=_LONG, segment_id=_LONG, narrator=_STR, audio_path=_STR, status=_STR, duration=_DBL
    ),
    "pipeline_events": _schema(
        id=_LONG, book_id=_LONG, task=_STR, level=_STR, message=_STR, traceback=_STR, created_at=_TS
    ),
    "ab_tests": _schema(id=_LONG, title=_STR, description=_STR, published=_BOOL, created_at=_TS),
    "ab_options": _schema(
        id=_LONG, ab_test_id=_LONG, key=_STR, label=_STR, audio_key=_STR, opt_order=_INT
    ),
    "ab_votes": _schema(ab_test_id=_LONG, user_id=_LONG, choice=_STR, created_at=_TS),
}

# Nested layout of one page: what a PDF reader yields before any cleaning.
PAGE_LAYOUT = (
    "doc_id bigint, page_no int, page_h double, "
    "blocks array<struct<block_no:int, block_type:int, y0:double, y1:double, "
    "lines:array<array<struct<text:string, size:double>>>>>"
)

BOOK_STATUSES = ("pending", "processing", "review", "synthesizing", "complete", "error")
