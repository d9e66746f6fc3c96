"""English stop words for the TF-IDF vectoriser.

The default is Spark ML's own English list (``StopWordsRemover.loadDefaultStopWords``). It is
read from the Spark ML jar that ships with PySpark, so the same list is available to code that
runs without a JVM (the DuckDB oracle). Callers may pass any other list to the TF-IDF operators.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

_RESOURCE = "org/apache/spark/ml/feature/stopwords/{lang}.txt"


@functools.lru_cache(maxsize=None)
def default_stop_words(lang: str = "english") -> tuple[str, ...]:
    import pyspark

    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            try:
                raw = z.read(_RESOURCE.format(lang=lang)).decode("utf-8")
            except KeyError:
                continue
        return tuple(w for w in raw.split() if w)
    # No jar on the local path (e.g. a thin client): ask the JVM.
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(lang))
