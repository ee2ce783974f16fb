import hashlib

from pyspark.sql import functions as F

from lamella.llm import warc
from lamella.llm.queries import op5_warc
from lamella.llm.storage import new_path
from lamella.llm.warc import filesystem, page_record, plan_records, ranges, read_warc, write_warc


def expected(pages):
    """page_id, bytes, digest, type, refers_to for rows of page_id, html, by looking at all of them."""
    last = {}
    for page, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000:
            key = hashlib.sha1(data).hexdigest()
            last[key] = max(last.get(key, page), page)
    out = []
    for page, html in pages:
        data = (html or "").encode()
        key = hashlib.sha1(data).hexdigest()
        revisit = key in last and last[key] != page
        out.append((page, len(data), key, "revisit" if revisit else "response", last[key] if revisit else None))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op5_warc(spark, sf_dir).collect()), key=str) == expected(pages)


def test_round_trip_with_copies_nulls_and_rolling(spark):
    long, other = "é<p>" * 400, "x" * 999
    pages = [(1, "http://a/1", long), (2, None, None), (3, "http://a/\r\n3", long), (4, "", other), (5, "http://a/5", other), (7, "http://a/7", long), (7, "http://a/7", long), (None, "http://n", "n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    folder = new_path(spark, "warc-test")
    manifest = write_warc(plan_records(df), folder, roll_bytes=400).collect()
    assert sum(m.records for m in manifest) == len(pages) and len(manifest) > 2
    fs, path = filesystem(folder)
    for m in manifest:
        with fs.open_input_stream(f"{path}/{m.file}", compression=None) as stream:
            data = stream.read()
        assert len(data) == m.bytes and hashlib.sha1(data).hexdigest() == m.sha1
    rows = read_warc(spark, folder).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)
    assert got == expected([(p if p is not None else -1, h) for p, _, h in pages][:-1]) + [(None, 1, hashlib.sha1(b"n").hexdigest(), "response", None)]
    texts = {(r.page_id, None if r.payload is None else bytes(r.payload).decode()) for r in rows}
    assert (7, long) in texts and (1, None) in texts and (4, other) in texts and (2, "") in texts


def test_same_rows_give_same_files(spark):
    df = spark.range(50).select(F.col("id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.repeat(F.col("id").cast("string"), 300).alias("html"))
    hashes = []
    for _ in range(2):
        manifest = write_warc(plan_records(df.repartition(3)), new_path(spark, "warc-same"), roll_bytes=2000).collect()
        hashes.append(sorted((m.file, m.sha1) for m in manifest))
    assert hashes[0] == hashes[1]


def written(spark, df, monkeypatch, least=1 << 15):
    monkeypatch.setattr(warc, "LEAST_RANGE", least)
    manifest = write_warc(plan_records(df), folder := new_path(spark, "warc-many")).collect()
    fs, path = filesystem(folder)
    from pyarrow.fs import FileSelector

    assert not [x.path for x in fs.get_file_info(FileSelector(path)) if "_temporary" in x.path]
    return sorted((m.file, m.sha1, m.records, m.first_page, m.last_page) for m in manifest)


def test_many_rows_in_any_order_give_same_sorted_files(spark, monkeypatch):
    """More rows than a sample would look at, with ids far apart and one id that a third of the rows have."""
    i = F.col("id")
    page = F.when(i % 3 == 0, 5).when(i % 1000 == 1, i * 10**14).when(i % 1000 == 2, -i).otherwise(i)
    df = spark.range(30000).select(page.alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha1(i.cast("string")), 2).alias("html"))
    first = written(spark, df.repartition(3), monkeypatch)
    assert first == written(spark, df.repartition(7), monkeypatch)
    assert sum(m[2] for m in first) == 30000 and len(first) > 40 and max(m[2] for m in first) < 2000
    assert all(a[4] <= b[3] for a, b in zip(first, first[1:]))


def test_ranges_of_all_ids(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_RANGE", 100)
    top = (1 << 63) - 1
    df = spark.createDataFrame([(x, 60) for x in (-top - 1, -5, 0, 1, 2, top - 1, top)], "id long, bytes long")
    starts, cuts = ranges(df)
    assert starts[0] == -top - 1 and starts == sorted(starts) and set(cuts) == {1} and len(starts) >= 4
    assert ranges(df.limit(0)) == ([-top - 1], [1])


def test_revisits_name_what_they_refer_to(spark):
    long = "x" * 2000
    df = spark.createDataFrame([(1, "http://a", long), (2, "http://b", long)], "page_id long, url string, html string")
    row = next(r for r in plan_records(df).collect() if r.record_type == "revisit")
    text = page_record(row.asDict(), "2024-01-01T00:00:00Z").decode()
    assert "WARC-Refers-To-Target-URI: http://b\r\n" in text and "WARC-Refers-To-Date: 2024-01-01T00:00:00Z\r\n" in text


def test_empty(spark):
    folder = new_path(spark, "warc-empty")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert write_warc(plan_records(df), folder).count() == 0
    assert read_warc(spark, folder).count() == 0


def test_a_lost_attempt_is_replaced(spark):
    folder = new_path(spark, "warc-lost")
    fs, path = filesystem(folder)
    fs.create_dir(path)
    with fs.open_output_stream(f"{path}/pages-000000-0000.warc.gz") as stream:
        stream.write(b"half a file")
    df = spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")
    assert write_warc(plan_records(df), folder).count() == 1
    assert [r.page_id for r in read_warc(spark, folder).collect()] == [1]
