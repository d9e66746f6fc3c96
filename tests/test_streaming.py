"""Structured Streaming reports over a file stream of raw posts (memory sink)."""

import os
import tempfile


from murmuration.operators.roles import Roles
from murmuration.streaming.volume import preprocess_stream, stream_hashtag_counts, stream_volume


def test_stream_volume_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="murmuration-stream-")
    rows = [(i, f"u{i % 3}", f"2024-01-0{1 + i % 3} 10:00:00", f"post {i} #tag{i % 2}",
             "https://x.com/1") for i in range(30)]
    schema = "post_id long, author string, created_at string, content string, link string"
    for part in range(3):
        spark.createDataFrame(rows[part * 10:(part + 1) * 10], schema).write.parquet(
            os.path.join(d, f"batch={part}"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(d, "batch=*"))
    roles = Roles(text="content", influencer="author", timestamp="created_at", url="link",
                  platform_mode="infer")
    posts = preprocess_stream(stream, roles, watermark="10 days", id_col="post_id",
                              order_cols=["post_id"])
    q1 = stream_volume(posts, "1 day").writeStream.outputMode("update").format("memory") \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="murmuration-sq-")) \
        .queryName("vol_test").start()
    q2 = stream_hashtag_counts(posts, "1 day").writeStream.outputMode("update").format("memory") \
        .option("checkpointLocation", tempfile.mkdtemp(prefix="murmuration-sq-")) \
        .queryName("tags_test").start()
    try:
        q1.processAllAvailable()
        q2.processAllAvailable()
        vol = spark.sql("SELECT bucket_start, max(posts) AS posts FROM vol_test GROUP BY 1")
        assert sorted(r["posts"] for r in vol.collect()) == [10, 10, 10]
        tags = spark.sql("SELECT hashtag, sum(frequency) AS n FROM (SELECT bucket_start, hashtag, "
                         "max(frequency) AS frequency FROM tags_test GROUP BY 1, 2) GROUP BY 1")
        assert {r["hashtag"]: r["n"] for r in tags.collect()} == {"#tag0": 15, "#tag1": 15}
    finally:
        q1.stop()
        q2.stop()
