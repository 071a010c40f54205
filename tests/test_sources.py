"""Sources and sinks: landed-file layout, filing-date rules, CSV round trip, fallback source."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import bindings as b
from ledgerlens.sources import filings as fl
from ledgerlens.sources import qa, tables


def _write(root, ticker, ftype, sub, name, content):
    d = os.path.join(root, "sec-edgar-filings", ticker, ftype, sub)
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, name), "w", encoding="utf-8") as f:
        f.write(content)


def test_filing_scan_and_index_on_reference_layout(spark):
    root = tempfile.mkdtemp(prefix="landed-")
    head49 = "\n".join(f"line {i}" for i in range(49))
    _write(root, "AAPL", "10-K", "s1", "full-submission.txt", "x\nFILED AS OF DATE:\t\t20240201\n<p>a</p>")
    _write(root, "AAPL", "10-Q", "s2", "full-submission.txt", head49 + "\nFILED AS OF DATE: 20230105\nbody")
    _write(root, "AAPL", "10-Q", "s3", "full-submission.txt", head49 + "\nline 50\nFILED AS OF DATE: 20230105")
    _write(root, "MSFT", "10-K", "s4", "full-submission.txt", "FILED AS OF DATE: 2024 FILED AS OF DATE: 1999\n")
    _write(root, "MSFT", "10-K", "s5", "other.txt", "FILED AS OF DATE: 20240101")
    _write(root, "MSFT", "8-K", "s6", "full-submission.txt", "FILED AS OF DATE: 20240101")
    _write(root, "MSFT", "10-K", "s7", "full-submission.txt", "FILED AS OF DATE: 2024")
    files = fl.filing_scan(spark, root)
    assert files.count() == 6  # other.txt is not a full submission
    idx = fl.filing_index(files).collect()
    got = [(r.ticker, r.filing_type, str(r.filing_date) if r.filing_date else None,
            os.path.basename(os.path.dirname(r.file_path))) for r in idx]
    assert got == [
        ("AAPL", "10-Q", "2023-01-05", "s2"),   # marker on line 50 is found
        ("AAPL", "10-K", "2024-02-01", "s1"),
        ("AAPL", "10-Q", None, "s3"),           # marker on line 51 is not
        ("MSFT", "10-K", None, "s4"),           # text between two markers: '2024' -> unparsable
        ("MSFT", "10-K", None, "s7"),           # short date
    ]


def test_missing_root_is_empty(spark):
    assert fl.filing_scan(spark, "/nonexistent/ledgerlens/root").count() == 0


def test_csv_round_trip_multiline(spark):
    df = spark.createDataFrame([(1, 'a "quoted"\nline, with comma'), (2, "")], "id int, text string")
    path = tables.csv_sink(df, tempfile.mkdtemp(prefix="csv-") + "/out")
    back = tables.csv_source(spark, path, df.schema).orderBy("id").collect()
    assert back[0].text == 'a "quoted"\nline, with comma'


def test_qa_fallback(spark, tmp_path):
    given = spark.createDataFrame([("c", "q", "a")], "context string, question string, answer string")
    assert qa.qa_source_fallback(spark, ["/nonexistent/a", "/nonexistent/b"], given).collect() == given.collect()
    given.write.parquet(str(tmp_path / "qa"))
    assert qa.qa_source_fallback(spark, ["/nonexistent/a", str(tmp_path / "qa")]).count() == 1
    with pytest.raises(FileNotFoundError):
        qa.qa_source_fallback(spark, ["/nonexistent/a"])
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer"):
        qa.qa_source_fallback(spark, [str(tmp_path / "bad")], given).collect()


def test_ticker_normalize(spark):
    df = spark.createDataFrame([("BRK.B",), ("AAPL",)], "t string")
    assert [r.n for r in df.select(fl.ticker_normalize(F.col("t")).alias("n")).collect()] == ["BRK-B", "AAPL"]


def test_vector_table_is_deterministic_and_appends_new_ids(spark, tmp_path):
    from pyspark.sql import functions as F

    from ledgerlens.sources import tables as tb

    rows = [(f"id{i % 4}", [float(i)], f"text {9 - i}") for i in range(8)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, document string")
    found = set()
    for n in (1, 2, 5):
        path = tb.vector_table_write(df.repartition(n), str(tmp_path / f"v{n}"), reset=True)
        found.add(tuple(sorted(map(str, tb.vector_table_read(spark, path).collect()))))
    assert len(found) == 1 and tb.vector_id_collisions(df).count() == 4
    tb.vector_table_write(df.withColumn("document", F.lit("later")).unionByName(spark.createDataFrame([("new", [1.0], "n")], df.schema)), path)
    again = {r.id: r.document for r in tb.vector_table_read(spark, path).collect()}
    assert len(again) == 5 and "later" not in again.values()
    fresh = tb.vector_table_write(df, str(tmp_path / "none"))
    assert tb.vector_table_read(spark, fresh).count() == 4


def test_one_failing_filing_keeps_the_others(spark):
    from ledgerlens.operators import hooks

    def fn(pdf):
        if pdf["i"].iloc[0] == 500:
            raise ValueError("broken")
        return pdf.assign(n=pdf["i"] * 2)[["i", "n"]]

    got = hooks.apply_per_filing(spark.range(1000).withColumnRenamed("id", "i"), fn, "i long, n long").collect()
    assert len(got) == 1000 and [(r.i, r.n, r.error) for r in got if r.error] == [(500, None, "ValueError: broken")]
    assert all(r.n == 2 * r.i for r in got if not r.error)


def test_append_touches_only_the_buckets_of_new_ids(spark, tmp_path):
    from ledgerlens.sources import tables as tb

    schema = "id string, embedding array<float>, document string"
    df = spark.createDataFrame([(f"id{i}", [float(i)], f"text {i}") for i in range(300)], schema)
    path = tb.vector_table_write(df, str(tmp_path / "v"), reset=True, buckets=16)
    listing = lambda: {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}
    before = listing()
    assert len({os.path.dirname(f) for f in before}) == 16
    more = spark.createDataFrame([("new1", [1.0], "b"), ("new1", [0.0], "a"), ("new2", [2.0], "c"), ("id7", [9.0], "again")], schema)
    tb.vector_table_write(more, path)
    after = listing()
    assert {f: after[f] for f in before} == before  # no file is rewritten
    assert len({os.path.dirname(f) for f in after if f not in before}) <= 2
    got = {r.id: (r.document, list(r.embedding)) for r in tb.vector_table_read(spark, path).collect()}
    assert len(got) == 302 and got["new1"] == ("a", [0.0]) and got["id7"] == ("text 7", [7.0])
    plan = tb.vector_table_rows(more, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    with pytest.raises(ValueError, match="without buckets"):
        df.write.parquet(str(tmp_path / "flat"))
        tb.vector_table_write(df, str(tmp_path / "flat"))


def test_ids_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    from ledgerlens.sources import tables as tb

    monkeypatch.setattr(tb, "MAX_BROADCAST_IDS", 1)
    rows = [(f"id{i % 50}", [float(i)], f"text {99 - i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, document string")
    path = tb.vector_table_write(df, str(tmp_path / "v"), reset=True)
    tb.vector_table_write(df, path)
    least = {}
    for i, _, t in rows:
        least[i] = min(least.get(i, t), t)
    assert {r.id: r.document for r in tb.vector_table_read(spark, path).collect()} == least and tb.vector_table_read(spark, path).count() == 50


def test_index_reads_only_heads(spark, tmp_path):
    big = "x" * 200 + "\n"
    _write(str(tmp_path), "A", "10-K", "s1", "full-submission.txt", "a\nFILED AS OF DATE:\t\t20240201\n" + big * 50_000)
    _write(str(tmp_path), "A", "10-K", "s2", "full-submission.txt", big * 49 + "FILED AS OF DATE: 20230105\n" + big * 50_000)
    _write(str(tmp_path), "B", "10-K", "s3", "full-submission.txt", big * 50 + "FILED AS OF DATE: 20230105\n" + big * 50_000)
    _write(str(tmp_path), "B", "10-K", "s4", "full-submission.txt", "")
    _write(str(tmp_path), "B", "10-K", "s5", "full-submission.txt", "é\xa0 FILED AS OF DATE: 20220105")
    files = fl.filing_scan(spark, str(tmp_path))
    key = lambda df: sorted((r.ticker, r.file_path.replace("file:///", "file:/"), str(r.filing_date)) for r in fl.filing_index(df).collect())
    heads = fl.filing_heads(spark, str(tmp_path))
    assert key(heads) == key(files) and len(key(files)) == 4  # Spark lists no empty files
    assert all(len(r.content) <= 201 * 50 for r in heads.collect())
    for path, most in (("A/10-K/s1", fl.HEAD_BYTES), ("A/10-K/s2", 201 * 50 + fl.HEAD_BYTES), ("B/10-K/s3", 201 * 50 + fl.HEAD_BYTES)):
        assert fl.read_head(f"{tmp_path}/sec-edgar-filings/{path}/full-submission.txt")[1] <= most
    assert fl.filing_heads(spark, str(tmp_path / "none")).count() == 0


def test_many_folders_are_listed_by_few_tasks_and_filings_are_shuffled_once(spark, tmp_path):
    """A folder per filing: the listing takes some tasks per core; landing does not shuffle the texts a second time."""
    for i in range(120):
        d = tmp_path / "in" / "sec-edgar-filings" / "A" / "10-K" / f"s{i}"
        d.mkdir(parents=True)
        (d / "full-submission.txt").write_text(f"FILED AS OF DATE: 202001{i % 28 + 1:02d}\n")
    before = spark.conf.get(fl.LISTING_TASKS)
    spark.sparkContext.setJobGroup("listing", "listing")
    files = fl.filing_scan(spark, str(tmp_path / "in"))
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert files.count() == 120 and spark.conf.get(fl.LISTING_TASKS) == before
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism < 120
    docs = spark.createDataFrame([(i, f"src{i % 3}", f"text {i}") for i in range(900)], "doc_id long, source string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    filings = b.synthetic_filings(spark, str(tmp_path))
    assert filings.count() == 9
    plan = filings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
