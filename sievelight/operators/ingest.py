"""The crawl filters, cheap ones first, and their funnel."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain, visible_text

#: Thresholds, inclusive: bytes of HTML, visible characters, confidence of the language.
MIN_BYTES, MAX_BYTES, MIN_TEXT, MIN_CONFIDENCE, LID_CHARS = 2000, 500_000, 200, 0.8, 2000
#: Frequent English words for the stand-in language detector.
ENGLISH = frozenset("the of and to in is that for it as was with be by on not he this are or his from at which but have an they you were".split())

LanguageId = Callable[[str], tuple[str, float]]


def html_response(status: Column, content_type: Column) -> Column:
    """A page delivered as HTML."""
    return (status == 200) & F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))


def right_size(html: Column | str, least: int = MIN_BYTES, most: int = MAX_BYTES) -> Column:
    return F.octet_length(html).between(least, most)


def stopword_language(text: str) -> tuple[str, float]:
    """English by the share of frequent words; deterministic, and no match for a trained detector. Replace it with one."""
    words = re.findall(r"[a-z]+", text.lower())
    share = sum(w in ENGLISH for w in words) / len(words) if words else 0.0
    return ("en", min(1.0, 0.5 + 2.5 * share)) if share >= 0.05 else ("other", 1.0 - share)


def with_language(pages: DataFrame, text: str, detect: LanguageId = stopword_language) -> DataFrame:
    """pages with lang and lang_conf, judged by the first LID_CHARS characters of text."""
    udf = _detector(detect)
    found = pages.withColumn("__lid", udf(F.col(text)))
    return found.withColumn("lang", F.col("__lid.lang")).withColumn("lang_conf", F.col("__lid.lang_conf")).drop("__lid")


def lazily(make: Callable[[], LanguageId]) -> LanguageId:
    """A detector that is made at its first use, once in each Python worker: for models that are loaded from files."""
    key = f"{make.__module__}.{make.__qualname__}"

    def detect(text: str) -> tuple[str, float]:
        from sievelight.operators.ingest import _LOADED  # the worker's own, whatever was pickled

        if key not in _LOADED:
            _LOADED[key] = make()
        return _LOADED[key](text)

    return detect


#: A worker's detectors by what made them.
_LOADED: dict[str, LanguageId] = {}


def _detector(detect: LanguageId):
    @F.pandas_udf("lang string, lang_conf double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect((x or "")[:LID_CHARS].replace("\n", " ")) for x in texts], columns=["lang", "lang_conf"])

    return judge


def ingest(pages: DataFrame, detect: LanguageId = stopword_language, lang: str = "en") -> DataFrame:
    """url, domain, html, html_bytes, lang_conf of the pages that pass all filters. The native ones run in the scan's stage, before Python."""
    sized = pages.where(right_size("html")).withColumn("__text", visible_text("html")).where(F.length("__text") >= MIN_TEXT)
    judged = with_language(sized, "__text", detect).where((F.col("lang") == lang) & (F.col("lang_conf") >= MIN_CONFIDENCE))
    return judged.select("url", domain("url").alias("domain"), "html", F.octet_length("html").cast("long").alias("html_bytes"), F.bround("lang_conf", 3).alias("lang_conf"))


def funnel(pages: DataFrame) -> DataFrame:
    """How many pages pass the size filter, and how many of them have enough text: one pass, one row."""
    sized = right_size("html")
    texted = sized & (F.length(visible_text("html")) >= MIN_TEXT)
    kept = F.when(texted, F.octet_length("html"))
    return pages.agg(F.count("*").alias("n_records"), F.count_if(sized).alias("n_html"), F.count_if(texted).alias("n_text"), F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("kept_bytes"))
