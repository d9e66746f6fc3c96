"""Column-level building blocks (pure expressions, no actions)."""

from murmuration.functions.platform import PLATFORMS, infer_platform
from murmuration.functions.stopwords import default_stop_words
from murmuration.functions.text import (
    clean_text,
    hashtags,
    is_nonblank,
    mentions,
    nan_to_null,
    snippet,
    strip_retweet,
    strip_ws,
    tokens,
)
from murmuration.functions.timestamps import parse_timestamp
from murmuration.functions.vectors import cosine, dot, l2_norm, l2_normalize

__all__ = [
    "PLATFORMS", "infer_platform", "default_stop_words", "clean_text", "hashtags", "is_nonblank",
    "mentions", "nan_to_null", "snippet", "strip_retweet", "strip_ws", "tokens", "parse_timestamp",
    "cosine", "dot", "l2_norm", "l2_normalize",
]
