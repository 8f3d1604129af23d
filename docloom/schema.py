"""Fixed schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

#: One row per catalogued file, keyed by ``_id`` = sha256 of the normalised path.
DOCUMENT = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("file_type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_directory", T.StringType()),
    T.StructField("file_extension", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("created_date", T.TimestampNTZType()),
    T.StructField("modified_date", T.TimestampNTZType()),
    T.StructField("is_backed_up", T.BooleanType()),
    T.StructField("backup_path", T.StringType()),
    T.StructField("content", T.StringType()),
])

#: What a listing of the disk yields, before any filter.
LISTING = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("file_size", T.LongType()),
    T.StructField("modified_date", T.TimestampNTZType()),
    T.StructField("created_date", T.TimestampNTZType()),
])

#: One row of the inverted index. ``dl`` (field length of the document) is repeated on every
#: row so that scoring needs no join back to the documents.
POSTING = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("tf", T.LongType()),
    T.StructField("dl", T.LongType()),
])
