"""Sources and sinks."""

from murmuration.sources.files import NA_TOKENS, UnionResult, export_posts, load_posts, union_posts
from murmuration.sources.fixtures import FIXTURE_ROLES, RAW_POSTS_SQL, raw_posts, table

__all__ = ["NA_TOKENS", "UnionResult", "export_posts", "load_posts", "union_posts",
           "FIXTURE_ROLES", "RAW_POSTS_SQL", "raw_posts", "table"]
