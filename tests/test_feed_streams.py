"""Feeds as streams, and dump lines across splits."""

from pyspark.sql import functions as F

from brightloom.sources import feeds, tables


def rss(ids):
    return "<rss><channel><title>x</title>" + "".join(f'<item><guid isPermaLink="false">urn:{i}</guid><link>https://a.example/{i}</link><title> T {i} </title><pubDate>Mon, 01 Jan 2024 08:00:00 GMT</pubDate><description>&lt;p&gt;b{i}&lt;/p&gt;</description></item>' for i in ids) + "</channel></rss>"


def atom(ids):
    return "<feed><title>x</title>" + "".join(f'<entry><id>urn:{i}</id><link href="https://a.example/{i}" rel="alternate"/><title>T{i}</title><updated>2024-01-01</updated><content>b{i}</content></entry>' for i in ids) + "</feed>"


def check(spark, tmp_path, render, stream, batch):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for n, ids in enumerate((range(5), range(5, 9), range(9, 9), range(9, 14))):
        (folder / f"{n}.xml").write_text(render(ids))
        query = stream(spark, str(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    cols = [c for c in batch(spark, str(folder)).columns if c != "position"]
    got, want = spark.read.parquet(out).select(*cols).collect(), batch(spark, str(folder)).select(*cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 14 and len({r.fingerprint for r in got}) == 14


def test_rss_stream_reads_each_file_once(spark, tmp_path):
    check(spark, tmp_path, rss, feeds.rss_stream, feeds.rss_entries)


def test_atom_stream_reads_each_file_once(spark, tmp_path):
    check(spark, tmp_path, atom, feeds.atom_stream, feeds.atom_entries)


def test_dump_lines_across_splits(spark, tmp_path):
    path = tmp_path / "dump.txt"
    path.write_text("".join(f"{i}\tt\t{'文' * (i % 300)}\\tx\\\\\n" for i in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    try:
        rows = tables.read_dump_rows(spark, str(path), [("id", "bigint"), ("flag", "boolean"), ("body", "text")])
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 50
        got = {r.id: (r.flag, r.body) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {str(i): ("1", "文" * (i % 300) + "\tx\\") for i in range(2000)}
