"""Language identification by compression.

For each language of the training rows, a zstandard raw-content dictionary is made of the most frequent words of a
bounded sample of its documents, the most frequent last. A text is folded to its words (runs of letters in lower
case, with all repeats) and encoded whole with every dictionary, in pieces of PIECE bytes, so that the dictionary is in
reach throughout; the smallest encoding names the language. Equal sizes go to the language with more sampled words, then
the smaller name. score is the margin to the second best, as a share of it (1.0 if there is only one language). Texts
whose margin is below least_margin are rejected, as are texts without a letter.

Documented bounds: sample_docs documents a language, dictionary_bytes a dictionary; the languages are few enough for
one dictionary each, so their counts are broadcast. All documents are classified by their whole texts, without a shuffle.

Nulls and ties: a null text or one without letters (of Unicode's letter categories; numerals are none) is `und`, score 0.0 and
rejected; a null lang teaches nothing; without any training row all are `und`. Repeated rows are judged alike; very long texts
take longer, not more memory than their own; columns beside the ones named are carried if asked for; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table, trimming

SAMPLE_DOCS, DICTIONARY_BYTES, LEVEL, LEAST_MARGIN, FOLDS, PIECE = 200, 65_536, 6, 0.005, 5, 262_144
UNKNOWN = "und"
#: Ids of sampled documents up to which they are broadcast; of more (very many languages) the texts are shuffled to them.
BROADCAST_DOCS = 100_000
_WORD = re.compile(r"[^\W\d_]+")
#: Goes before each text, so that no text is too short for zstandard to encode at all.
_LEAD = bytes(64)


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numerals such as a half are no letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    return found


def folded(text: str) -> bytes | None:
    """The text's words; None without letters."""
    words = words_of(text)
    return (" " + " ".join(words) + " ").encode() if words else None


def held_out() -> Column:
    """Whether a document is one of the fold that training never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> list[tuple[str, int, bytes]]:
    """labelled: doc_id, text, lang. A list of (language, words sampled, dictionary), larger samples first."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    # Which documents: those with the smallest hashes of their ids, without moving their texts. Of a language with many documents
    # only a share that holds three times the sample goes on; a language where chance leaves too few of them has a smaller sample.
    counts = usable.groupBy("lang").agg(F.count("*").alias("docs"))
    share = 3.0 * sample_docs / F.col("docs") + 100.0 / F.col("docs")
    few = usable.select("lang", "doc_id").join(F.broadcast(counts), "lang").where(F.xxhash64("doc_id") / 2.0**64 + 0.5 <= share)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs).select("lang", "doc_id").distinct()
    chosen = stored(chosen, "language-sample")
    small = chosen.count() <= BROADCAST_DOCS
    texts = usable.select("lang", "doc_id", "text").join(F.broadcast(chosen) if small else chosen, ["lang", "doc_id"], "left_semi")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                own = words_of(text)
                found.extend(own)
                langs.extend([lang] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], names=["lang", "word"])

    counts = texts.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("lang", "word").count()
    most = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    size = F.sum(F.octet_length("word") + 1).over(most.rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("size", size).withColumn("total", F.sum("count").over(Window.partitionBy("lang"))).where(F.col("size") <= dictionary_bytes).collect()
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["size"], r["word"], r["total"]))
    made = []
    for lang, own in by.items():
        own.sort(reverse=True)
        made.append((lang, own[0][2], (" " + " ".join(word for _, word, _ in own) + " ").encode()))
    return sorted(made, key=lambda m: (-m[1], m[0]))


def classify(docs: DataFrame, model: list[tuple[str, int, bytes]], keep: list[str], level: int = LEVEL, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The columns in keep with lang_pred, score and rejected."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"__{i}" for i in range(len(keep))]
    given = docs.select(F.col("text").alias("__text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    schema = ", ".join([f"{n} {given.schema[n].dataType.simpleString()}" for n in names] + ["lang_pred string", "score double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang, _, content in known.value:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=20)
            dictionary.precompute_compress(compression_params=settings)
            coders.append((lang, zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)))
        for batch in batches:
            langs, scores, out = [], [], []
            for text in batch.column("__text").to_pylist():
                plain = folded(text) if text and coders else None
                if plain is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    out.append(True)
                    continue
                pieces = [_LEAD + plain[lo : lo + PIECE] for lo in range(0, len(plain), PIECE)]
                sizes = sorted((sum(len(coder.compress(piece)) for piece in pieces), i) for i, (_, coder) in enumerate(coders))
                margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
                langs.append(coders[sizes[0][1]][0])
                scores.append(margin)
                out.append(margin < least_margin)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    made = given.mapInArrow(trimming(run), schema)
    return made.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "lang_pred", "score", "rejected")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return classify(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language": op4_language}
ORACLE_SQL: dict[str, str] = {}
