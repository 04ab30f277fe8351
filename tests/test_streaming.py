from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pageloom.session import new_path
from pageloom.sources import store
from pageloom.streaming import content as st

SCHEMA = "url string, content_hash string, extracted_at timestamp, tags array<string>"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def files(spark, *batches):
    folder = new_path(spark, "source")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")
    return folder


def stream(spark, folder, one_by_one=True):
    reader = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true")
    if one_by_one:
        reader = reader.option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


BATCHES = (
    [("u1", "h1", at(0), ["a"]), ("u2", "h1", at(1), ["a"])],
    [("u1", "h2", at(2), ["b"]), ("u3", "h3", at(3), ["a", "b"])],
    [("u4", "h3", at(4), []), ("u5", None, at(50), ["a"])],
)
UNHASHED = [("u6", None, at(51), ["a"])]


def test_ingest_equals_batch_and_resumes(spark):
    folder, table, state = files(spark, *BATCHES), new_path(spark, "t"), new_path(spark, "s")
    for _ in range(2):  # the second run finds nothing new
        st.ingest(stream(spark, folder), table, state).awaitTermination()
    got = sorted(r["url"] for r in store.read_content(spark, table).collect())
    everything = spark.createDataFrame([r for b in BATCHES for r in b], SCHEMA)
    assert got == sorted(r["url"] for r in store.accepted(everything).collect()) == ["u1", "u3", "u5"]


def test_deduplicated(spark):
    folder, path = files(spark, *BATCHES, UNHASHED), new_path(spark, "d")
    kept = st.deduplicated(stream(spark, folder), "extracted_at", "100 days")
    st.write_files(kept, path, new_path(spark, "s")).awaitTermination()
    hashes = [r["content_hash"] for r in spark.read.parquet(path).collect()]
    assert sorted(map(str, hashes)) == ["None", "None", "h1", "h2", "h3"]


def test_trending_counts_running_windows_and_late_files(spark):
    folder, path = files(spark, *reversed(BATCHES)), new_path(spark, "w")
    counts = st.trending(stream(spark, folder), "extracted_at", None, "1 day", "1 day")
    st.write_changes(counts, path, new_path(spark, "s")).awaitTermination()
    found = st.read_changes(spark, path, ["window_start", "topic"]).collect()
    assert {(r["window_start"], r["topic"]): r["count"] for r in found} == {
        (at(0), "a"): 3, (at(0), "b"): 2, (at(48), "a"): 1,
    }


def test_late_rows_are_counted(spark):
    folder, path = files(spark, BATCHES[2], BATCHES[0], BATCHES[1]), new_path(spark, "d")
    kept = st.deduplicated(stream(spark, folder), "extracted_at", "1 hour")
    query = st.write_files(kept, path, new_path(spark, "s"))
    query.awaitTermination()
    # One more row repeats a key.
    assert st.late_rows(query) == 2 and spark.read.parquet(path).count() == 3


def table(spark, rows, parts):
    """A table as a folder of files, the later rows in the earlier files."""
    folder = new_path(spark, "tables")
    for number in range(parts):
        mine = rows[number::parts]
        spark.createDataFrame(mine, SCHEMA).coalesce(1).write.parquet(f"{folder}/rows.parquet", mode="append")
    return folder


def test_a_table_may_be_a_folder_of_files(spark):
    rows = [(f"u{n:02}", f"h{n % 5}", at(40 - n), ["a"]) for n in range(40)]
    folder = table(spark, rows, 4)
    stream_of = lambda: st.read_stream(spark, folder, "rows", SCHEMA)
    first, path = {("u35", "h0"), ("u36", "h1"), ("u37", "h2"), ("u38", "h3"), ("u39", "h4")}, new_path(spark, "d")
    st.write_files(st.deduplicated(stream_of(), "extracted_at", "100 days"), path, new_path(spark, "s")).awaitTermination()
    assert {(r["url"], r["content_hash"]) for r in spark.read.parquet(path).collect()} == first
    saved = new_path(spark, "t")
    st.ingest(stream_of(), saved, new_path(spark, "s")).awaitTermination()
    assert {(r["url"], r["content_hash"]) for r in store.read_content(spark, saved).collect()} == first


def test_a_table_may_be_a_single_file(spark, small):
    stream_of = st.read_stream(spark, small, "documents", "doc_id bigint")
    path = new_path(spark, "d")
    st.write_files(stream_of, path, new_path(spark, "s")).awaitTermination()
    assert spark.read.parquet(path).count() == spark.read.parquet(f"{small}/documents.parquet").count()
