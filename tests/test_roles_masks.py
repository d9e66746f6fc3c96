"""Role resolution from row masks against the checks done one by one."""

import random

from pyspark.sql import functions as F

from murmuration.operators import roles


def test_many_candidates_equal_single_checks(spark):
    """Ten text and eight time candidates, some blank in every row that an earlier choice keeps."""
    rng = random.Random(3)
    names = [*roles.TEXT_ALIASES, *roles.TIMESTAMP_ALIASES, "author", "media_name", "url", "link",
             "Platform"]
    times = ["2024-01-02", "3 Jan 2024", "soon", " ", None, ""]
    for trial in range(4):
        blank = set(rng.sample(names, 12))
        rows = []
        for _ in range(25):
            row = {}
            for n in names:
                kind = times if n in roles.TIMESTAMP_ALIASES else ["x", "nan", " ", None]
                row[n] = " " if n in blank else rng.choice(kind)
            rows.append(tuple(row[n] for n in names))
        df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        got = roles.resolve_roles(df)

        def any_row(frame, cond):
            return frame.where(cond).limit(1).count() > 0

        def first(frame, aliases):
            return next((a for a in aliases if a in names
                         and any_row(frame, roles._nonblank_or_null(a))), None)

        assert got.text == first(df, roles.TEXT_ALIASES)
        if got.text is None:
            continue
        kept = df.where(roles._valid_text(got.text))
        assert got.timestamp == first(kept, ["timestamp", *roles.TIMESTAMP_ALIASES]), trial
        assert got.influencer == first(kept, ["author", "media_name"])
        if got.timestamp is None:
            continue
        kept = kept.where(roles.parse_timestamp(F.col(got.timestamp)).isNotNull())
        assert got.url == first(kept, ["url", "link"])
