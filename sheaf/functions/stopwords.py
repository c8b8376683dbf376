"""English stop words: the list that ships with Spark ML, plus number words."""

from __future__ import annotations

import functools
import glob
import os
import re
import zipfile

import pyspark

_ENTRY = "org/apache/spark/ml/feature/stopwords/english.txt"

# Words that read as a number.
NUMBER_WORDS = frozenset(
    """
    zero one two three four five six seven eight nine ten eleven twelve thirteen
    fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty
    sixty seventy eighty ninety hundred thousand million billion trillion
    quadrillion gajillion bazillion
    first second third fourth fifth sixth seventh eighth ninth tenth eleventh
    twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth
    nineteenth twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth
    ninetieth hundredth thousandth millionth billionth trillionth quadrillionth
    gajillionth bazillionth
    """.split()
)


def _shipped_list() -> list[str]:
    homes = [os.environ.get("SPARK_HOME", ""), os.path.dirname(pyspark.__file__)]
    for home in filter(None, homes):
        for jar in glob.glob(os.path.join(home, "jars", "spark-mllib_*.jar")):
            with zipfile.ZipFile(jar) as archive:
                return archive.read(_ENTRY).decode("utf-8").split("\n")
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


@functools.cache
def english_stop_words() -> frozenset[str]:
    """Whole words, and the pieces of contractions as the token rule splits them."""
    words = [w.strip().lower() for w in _shipped_list()]
    return frozenset(p for w in words for p in [w, *re.split(r"['’]", w)] if p)
