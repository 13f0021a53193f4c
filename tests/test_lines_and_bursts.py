"""Line numbers over files and splits, and bursts that no window cuts."""

import datetime as dt

from curatrix.operators import campaigns
from curatrix.sources.files import lines_of_files


def test_line_numbers_equal_enumerate(spark, tmp_path):
    want = []
    for name, count in (("a.txt", 3000), ("b.txt", 1), ("c.txt", 0), ("d d.txt", 777)):
        lines = ["" if k % 13 == 0 else f"{name} {k} " + "x" * (k % 300) for k in range(count)]
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
        want += [(name, k, line) for k, line in enumerate(lines, 1)]
    for size in ("5000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            rows = lines_of_files(spark, f"file://{tmp_path}")
            got = [(r.file.rsplit("/", 1)[1].replace("%20", " "), r.line, r.value) for r in rows.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(got) == sorted(want)


def test_a_burst_over_an_edge_is_one_row(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    posts = [("buy", "a", at(8)), ("buy", "b", at(12)), ("buy", "a", at(21)), ("buy", "c", at(31)), ("buy", "c", at(32)), ("sell", "a", at(1)), ("sell", "a", at(2)), (None, "x", at(1)), (None, "y", at(1)), ("buy", "z", None)]
    df = spark.createDataFrame(posts, "text string, handle string, at timestamp")
    (row,) = campaigns.coordinated_bursts(df, "text", "handle", "at").collect()
    assert (row.n_posts, row.n_handles) == (3, 2) and (row.end - row.start) == dt.timedelta(minutes=13)  # 31 is ten minutes after 21: another run, of one account
    links = df.selectExpr("array('https://T.test/1', 'http://t.test/2', null, 'no url') as urls", "handle", "at")
    (row,) = campaigns.link_bursts(links.where("at is not null and handle in ('a', 'b')"), "urls", "handle", "at").collect()
    assert (row.host, row.n_posts, row.n_handles) == ("t.test", 5, 2)
    assert campaigns.coordinated_bursts(df.limit(0), "text", "handle", "at").count() == 0
