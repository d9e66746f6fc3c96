"""CSV ingest (NA tokens, all-string), multi-file union with failures, export round trip."""

import os
import tempfile

from murmuration.operators.preprocess import preprocess_posts
from murmuration.sources import export_posts, load_posts, union_posts
from murmuration.sources.files import DOUBLED_QUOTES


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_csv_na_tokens_and_union(spark):
    d = tempfile.mkdtemp(prefix="murmuration-src-")
    _write(os.path.join(d, "a.csv"),
           'text,author,Date,URL\n"hello, ""world""",u1,2024-01-01 10:00:00,NA\n'
           '"multi\nline",N/A,2024-01-02,https://t.me/x\n')
    _write(os.path.join(d, "b.csv"), "content,user,created_at\nbye,u2,2024-01-03\n")
    res = union_posts(spark, [os.path.join(d, "a.csv"), os.path.join(d, "missing.csv"),
                              os.path.join(d, "b.csv")])
    assert list(res.failed) == [os.path.join(d, "missing.csv")]
    rows = res.posts.collect()
    assert len(rows) == 3
    first = [r for r in rows if r["text"] and r["text"].startswith("hello")][0]
    assert first["text"] == 'hello, "world"' and first["URL"] is None
    assert all(isinstance(v, (str, type(None))) for r in rows for v in r)
    posts = preprocess_posts(load_posts(spark, os.path.join(d, "a.csv")))
    got = {r["Influencer"]: (r["text"], r["Platform"]) for r in posts.collect()}
    assert got == {"u1": ('hello, "world"', "Unknown"), "Unknown_User": ("multi line", "Telegram")}


def test_export_round_trip(spark):
    d = tempfile.mkdtemp(prefix="murmuration-exp-")
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "b", [])], "id long, t string, tags array<string>")
    export_posts(df, os.path.join(d, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(d, "csv"))
    assert sorted((r["id"], r["t"], r["tags"]) for r in back.collect()) == \
        [("1", "a", '["x"]'), ("2", "b", "[]")]
    export_posts(df, os.path.join(d, "pq"), fmt="parquet")
    assert spark.read.parquet(os.path.join(d, "pq")).count() == 2


def test_csv_export_is_read_back_whole(spark):
    d = tempfile.mkdtemp(prefix="murmuration-exp-")
    texts = ['say "hi", \\ there', "two\nlines", "  blanks kept  ", 'ends with \\', "'", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    export_posts(df, os.path.join(d, "csv"), **DOUBLED_QUOTES)
    back = load_posts(spark, os.path.join(d, "csv"))
    assert {int(r["id"]): r["text"] for r in back.collect()} == dict(enumerate(texts))


def test_many_files_are_few_scans(spark):
    d = tempfile.mkdtemp(prefix="murmuration-many-")
    for k in range(300):
        head = ["text,author", "author,text,extra", '"a ""b""",text'][k % 3]
        _write(os.path.join(d, f"{k}.csv"), f"{head}\nx{k},y{k}" + (",z\n" if k % 3 == 1 else "\n"))
    _write(os.path.join(d, "multi.csv"), '"two\nlines",text\na,b\n')
    paths = [os.path.join(d, f"{k}.csv") for k in range(300)]
    os.rename(paths[9], os.path.join(d, "9 é 100%.csv"))
    paths[9] = os.path.join(d, "9 é 100%.csv")
    paths[7:7] = [os.path.join(d, "gone.csv"), os.path.join(d, "multi.csv"),
                  os.path.join(d, "gone, too.csv")]
    res = union_posts(spark, paths)
    assert set(res.failed) == {os.path.join(d, "gone.csv"), os.path.join(d, "gone, too.csv")}
    assert res.loaded == [p for p in paths if p not in res.failed]
    plan = res.posts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 4
    rows = res.posts.collect()
    assert len(rows) == 301
    assert set(res.posts.columns) == {"text", "author", "extra", 'a "b"', "two\nlines"}
    got = {(r["text"], r["author"]) for r in rows}
    assert ("x0", "y0") in got and ("y1", "x1") in got and ("y2", None) in got
    assert union_posts(spark, []).posts is None
