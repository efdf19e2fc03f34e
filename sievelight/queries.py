"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.packing import pack
from .operators import inference, ingest, labels, metrics, resume
from .plans.extract import Config, extract, with_all, with_simplified
from .sources import readers, sinks
from .tables import new_table, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# Parts of SQL that several queries share.
_VISIBLE = r"""substr(trim(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 5000)"""
_TOKENS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '')"
#: Pages with their paragraphs numbered as blocks: the k-th <p> gets _item_id="k".
_NUMBERED = r"""SELECT page_id, string_agg(CASE WHEN k = 1 THEN part ELSE '<p _item_id="' || (k - 1) || '">' || part END, '' ORDER BY k) AS simplified
  FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS part, generate_subscripts(string_split(html, '<p>'), 1) AS k FROM pages) GROUP BY page_id"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("html", "<p>")
    marked = F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit('<p _item_id="'), k.cast("string"), F.lit('">'), p))), "")
    return table(spark, sf_dir, "pages").select("page_id", marked.alias("simplified"))


@query(f"""WITH v AS (SELECT html, CAST(octet_length(encode(html)) AS BIGINT) AS n, length({_VISIBLE}) AS chars FROM pages)
SELECT count(*) AS n_records, count(*) FILTER (WHERE n BETWEEN 2000 AND 500000) AS n_html,
  count(*) FILTER (WHERE n BETWEEN 2000 AND 500000 AND chars >= 200) AS n_text,
  CAST(coalesce(sum(n) FILTER (WHERE n BETWEEN 2000 AND 500000 AND chars >= 200), 0) AS BIGINT) AS kept_bytes FROM v""")
def ingest_funnel(spark, sf_dir):
    return ingest.funnel(table(spark, sf_dir, "pages"))


@query(f"SELECT page_id, {_VISIBLE} AS visible FROM pages")
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.visible_text("html").alias("visible"))


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS html_bytes FROM pages WHERE octet_length(encode(html)) BETWEEN 2000 AND 500000")
def size_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(ingest.right_size("html")).select("page_id", F.octet_length("html").cast("long").alias("html_bytes"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain FROM pages")
def domain_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.domain("url").alias("domain"))


#: The stand-in language detector in SQL: the share of frequent English words among the first 2,000 characters.
_ENGLISH = ", ".join(f"'{w}'" for w in sorted(ingest.ENGLISH))
_JUDGED = rf"""v AS (SELECT url, html, CAST(octet_length(encode(html)) AS BIGINT) AS html_bytes, {_VISIBLE} AS t FROM pages),
w AS (SELECT *, regexp_extract_all(lower(replace(substr(t, 1, 2000), chr(10), ' ')), '[a-z]+') AS words FROM v WHERE html_bytes BETWEEN 2000 AND 500000 AND length(t) >= 200),
j AS (SELECT *, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda x: x IN ({_ENGLISH}))) / len(words) ELSE 0.0 END AS share FROM w)"""


@query(rf"""WITH {_JUDGED} SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS domain, html_bytes, round_even(least(1.0, 0.5 + 2.5 * share), 3) AS lang_conf
FROM j WHERE share >= 0.05 AND least(1.0, 0.5 + 2.5 * share) >= 0.8""")
def ingest_pages(spark, sf_dir):
    """The whole cascade, with the stand-in language detector."""
    return ingest.ingest(table(spark, sf_dir, "pages")).select("url", "domain", "html_bytes", "lang_conf")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100")
def lang_filter_limit(spark, sf_dir):
    """The reference's own limit parameter, set to 100 pages."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").orderBy("doc_id").limit(100).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def lang_filter_all(spark, sf_dir):
    """The reference's default: no limit."""
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY doc_id LIMIT 200 OFFSET 20")
def resume_anti_join(spark, sf_dir):
    """Offset and limit are the resume operator's own parameters."""
    return resume.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", start=20, limit=200)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_all(spark, sf_dir):
    return resume.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT page_id, CAST(floor((row_number() OVER (ORDER BY page_id) - 1) / 50) AS BIGINT) AS batch FROM pages")
def batch_assignment(spark, sf_dir):
    return resume.batches(table(spark, sf_dir, "pages").select("page_id"), "page_id", 50)


@query("SELECT DISTINCT CAST(lpad(CAST(page_id AS VARCHAR), 5, '0') AS BIGINT) AS idx FROM pages")
def done_indices(spark, sf_dir):
    """Output names made of the page ids, and read back."""
    names = F.concat(F.lit("clean/warc_"), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit(".jsonl.zst"))
    return resume.done_indices(table(spark, sf_dir, "pages").select(names.alias("path")))


@query("""SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'page was dropped before a result' END AS error
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def gap_fill_errors(spark, sf_dir):
    return resume.fill_gaps(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(r"""WITH s AS (SELECT page_id, '<?xml version="1.0"' || chr(10) || ' encoding="utf-8"?>' || html AS html FROM pages)
SELECT page_id, md5(regexp_replace(html, '(?s)<\?xml\s+.*?\??>', '', 'g')) AS digest FROM s""")
def strip_xml_decl(spark, sf_dir):
    given = F.concat(F.lit('<?xml version="1.0"\n encoding="utf-8"?>'), "html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_xml_declaration(given)).alias("digest"))


_IMAGES = '<img src="/x/spacer.gif" alt="s"><IMG width=1 src="/t.png"><img src="/photo.jpg" alt="kept"><img src="data:image/png;base64,AA">'


@query(rf"""WITH s AS (SELECT page_id, replace(html, '</h1>', '</h1>{_IMAGES}') AS html FROM pages)
SELECT page_id, md5(regexp_replace(html, '(?i)<img\b[^>]*?(?:(?:width|height)\s*=\s*["'']?\s*1\b|src\s*=\s*["''][^"'']*(?:trans(?:parent)?|spacer|blank|pixel|1x1|clear)[^"'']*["'']|src\s*=\s*["'']data:image[^"'']*["''])[^>]*>', '', 'g')) AS digest FROM s""")
def strip_spacer_images(spark, sf_dir):
    given = F.replace(F.col("html"), F.lit("</h1>"), F.lit("</h1>" + _IMAGES))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_spacer_images(given)).alias("digest"))


@query(rf"""WITH n AS ({_NUMBERED}), s AS (
  SELECT page_id, string_split(regexp_replace(simplified, '(<[^<]*_item_id="\d+")', chr(1) || '\1', 'g'), chr(1)) AS parts FROM n)
SELECT page_id, CAST(k - 2 AS INTEGER) AS ord, regexp_extract(parts[k], '_item_id="(\d+)"', 1) AS item_id, trim(parts[k]) AS block
FROM (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS k FROM s)""")
def extract_blocks(spark, sf_dir):
    given = _numbered(spark, sf_dir).select("page_id", F.posexplode(T.extract_blocks("simplified")).alias("ord", "block"))
    return given.select("page_id", "ord", T.item_id(F.col("block")).alias("item_id"), "block")


@query(rf"""WITH n AS ({_NUMBERED})
SELECT page_id, CAST(unnest(regexp_extract_all(simplified, '_item_id="(\d+)"', 1)) AS BIGINT) AS item_id FROM n""")
def extract_item_ids(spark, sf_dir):
    return _numbered(spark, sf_dir).select("page_id", F.explode(T.item_ids("simplified")).alias("item_id"))


@query(rf"""WITH n AS ({_NUMBERED})
SELECT page_id, md5(regexp_replace(simplified, '(_item_id="\d+")', '[BLOCK] \1', 'g')) AS digest FROM n""")
def insert_block_markers(spark, sf_dir):
    return _numbered(spark, sf_dir).select("page_id", F.md5(T.insert_block_markers("simplified")).alias("digest"))


@query(r"""WITH RECURSIVE lines AS (
  SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: CAST(len(list_filter(regexp_split_to_array(l, '\s+'), lambda t: t <> '')) AS BIGINT)) AS costs FROM documents),
fold AS (
  SELECT doc_id, costs, 1 AS k, least(costs[1] + 1, 62) AS used, 0 AS chunk FROM lines
  UNION ALL
  SELECT doc_id, costs, k + 1,
    CASE WHEN used + least(costs[k + 1] + 1, 62) <= 62 THEN used + least(costs[k + 1] + 1, 62) ELSE least(costs[k + 1] + 1, 62) END,
    CASE WHEN used + least(costs[k + 1] + 1, 62) <= 62 THEN chunk ELSE chunk + 1 END
  FROM fold WHERE k < len(costs))
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(min(k) - 1 AS INTEGER) AS first_block, CAST(count(*) AS INTEGER) AS n_blocks, CAST(max(used) + 2 AS INTEGER) AS n_tokens
FROM fold GROUP BY doc_id, chunk""")
def pack_chunks(spark, sf_dir):
    """Lines as blocks, words as tokens, a budget of 64."""
    costs = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.size(T.whitespace_tokens(line)))
    packed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pack(costs, max_tokens=64)).alias("chunk", "c"))
    return packed.select("doc_id", "chunk", F.col("c.blocks")[0].alias("first_block"), F.size("c.blocks").alias("n_blocks"), F.col("c.tokens").alias("n_tokens"))


@query("SELECT doc_id, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) + 1 AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("n_tokens"))


@query("""WITH t AS (SELECT doc_id, CAST(floor(length(coalesce(text, '')) / 4) AS BIGINT) + 1 AS n_tokens FROM documents)
SELECT doc_id, n_tokens, CAST(greatest(1, floor(16384 / greatest(n_tokens, 1))) AS BIGINT) AS n_batch FROM t""")
def chunk_sort_batches(spark, sf_dir):
    return labels.length_batches(token_estimate(spark, sf_dir), "n_tokens")


@query("""SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS item_id, CAST(coalesce(l.quality, 0) AS INTEGER) AS prediction,
  CASE WHEN coalesce(l.quality, 0) = 1 THEN 'main' ELSE 'other' END AS label FROM documents d LEFT JOIN labels l USING (doc_id)""")
def predictions_to_labels(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("item_id"))
    return labels.regroup(blocks, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("prediction")), ["doc_id"])


@query("""SELECT d.source, count(*) AS n_blocks, count(*) FILTER (WHERE l.quality = 1) AS n_main, count(*) FILTER (WHERE l.quality IS DISTINCT FROM 1) AS n_other
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def label_counts(spark, sf_dir):
    blocks = table(spark, sf_dir, "documents").select("doc_id", "source")
    found = labels.regroup(blocks, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("prediction")), ["doc_id"])
    main = F.count_if(F.col("label") == "main")
    return found.groupBy("source").agg(F.count("*").alias("n_blocks"), main.alias("n_main"), (F.count("*") - main).alias("n_other"))


@query(r"""WITH s AS (SELECT doc_id, '1' || CASE quality WHEN 1 THEN 'main' ELSE 'other' END || '2' || CASE toxic WHEN 1 THEN 'main' ELSE 'other' END AS answer FROM labels),
e AS (SELECT doc_id, unnest(regexp_extract_all(answer, '(\d+(?:main|other))')) AS x FROM s)
SELECT doc_id, regexp_extract(x, '^\d+') AS item_id, regexp_extract(x, '[a-z]+$') AS label FROM e""")
def parse_compact_labels(spark, sf_dir):
    word = lambda c: F.when(F.col(c) == 1, "main").otherwise("other")
    answer = F.concat(F.lit("1"), word("quality"), F.lit("2"), word("toxic"))
    return table(spark, sf_dir, "labels").select("doc_id", F.inline(T.compact_labels(answer)))


@query("""WITH s AS (SELECT doc_id, unnest(['1', '2']) AS item_id, unnest([CASE quality WHEN 1 THEN 'main' ELSE 'other' END, CASE toxic WHEN 1 THEN 'main' ELSE 'other' END]) AS label FROM labels)
SELECT doc_id, item_id, label FROM s""")
def parse_json_labels(spark, sf_dir):
    """JSON answers, of which every second one is cut off behind its last pair."""
    word = lambda c: F.when(F.col(c) == 1, "main").otherwise("other")
    answer = F.concat(F.lit('Here: {"1": "'), word("quality"), F.lit('", "2" : "'), word("toxic"), F.lit('"'), F.when(F.col("doc_id") % 2 == 0, "}").otherwise(', "3": "ma'))
    return table(spark, sf_dir, "labels").select("doc_id", F.inline(T.response_labels(answer)))


@query(r"""WITH i AS (SELECT page_id, range(1, CAST(len(string_split(html, '<p>')) AS BIGINT)) AS ids FROM pages)
SELECT page_id, array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR) || 'other'), '') AS compact,
  '{' || array_to_string(list_transform(ids, lambda i: '"' || CAST(i AS VARCHAR) || '": "other"'), ', ') || '}' AS json,
  '<answer>\s*' || array_to_string(list_transform(ids, lambda i: CAST(i AS VARCHAR) || '(main|other)'), '') || '\s*</answer>' AS pattern FROM i""")
def dummy_response(spark, sf_dir):
    n = F.size(F.split("html", "<p>")) - 1
    ids = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "pages").select("page_id", T.dummy_response(ids).alias("compact"), T.dummy_response(ids, compact=False).alias("json"), T.guided_pattern(ids).alias("pattern"))


@query("SELECT d.doc_id, md5(CASE WHEN l.doc_id IS NOT NULL THEN 'done' ELSE coalesce(d.text, '') END) AS digest FROM documents d LEFT JOIN labels l USING (doc_id)")
def fallback_bypass(spark, sf_dir):
    filled = resume.fill_gaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return filled.select("doc_id", F.md5(labels.fallback(F.lit("done"), F.coalesce("text", F.lit("")))).alias("digest"))


_GRAMS = rf"""t AS (SELECT doc_id AS id, {_TOKENS} AS w FROM documents), u AS (SELECT item_id AS id, {_TOKENS} AS w FROM benchmark),
tg AS (SELECT id, array_to_string(w[i : i + 4], ' ') AS gram, count(*) AS n FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5) GROUP BY ALL),
ug AS (SELECT id, array_to_string(w[i : i + 4], ' ') AS gram, count(*) AS n FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM u WHERE len(w) >= 5) GROUP BY ALL)"""


@query(f"WITH {_GRAMS} SELECT id AS item_id, gram, n FROM ug")
def ngram_counts(spark, sf_dir):
    return metrics.ngram_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")


_PAIRS = f"""{_GRAMS}, pairs AS (
  SELECT tg.id AS doc_id, ug.id AS item_id, CAST(sum(least(tg.n, ug.n)) AS BIGINT) AS overlap FROM tg JOIN ug USING (gram) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, overlap, overlap / (len(t.w) - 4) AS p, overlap / (len(u.w) - 4) AS r FROM pairs JOIN t ON t.id = doc_id JOIN u ON u.id = item_id)"""


@query(f"WITH {_PAIRS} SELECT doc_id, item_id, overlap, round(p, 6) AS p, round(r, 6) AS r, round(2 * p * r / (p + r), 6) AS f1 FROM scored")
def rouge5_pairs(spark, sf_dir):
    found = metrics.rouge_pairs(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")
    # The benchmark item is the reference, so r is the share of its n-grams that the document has.
    return found.select("doc_id", "item_id", "overlap", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


#: Every document against its own first half: a reference and a prediction for each.
_SELF = rf"""t AS (SELECT doc_id, n_chars, {_TOKENS} AS w FROM documents),
h AS (SELECT doc_id, n_chars, w, w[1 : len(w) // 2] AS v FROM t),
wg AS (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS gram, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM h WHERE len(w) >= 5) GROUP BY ALL),
vg AS (SELECT doc_id, array_to_string(v[i : i + 4], ' ') AS gram, count(*) AS m FROM (SELECT doc_id, v, unnest(range(1, len(v) - 3)) AS i FROM h WHERE len(v) >= 5) GROUP BY ALL),
o AS (SELECT doc_id, sum(least(n, m)) AS overlap FROM wg JOIN vg USING (doc_id, gram) GROUP BY doc_id),
pr AS (SELECT h.doc_id, n_chars, len(v) = 0 AS empty, CASE WHEN overlap > 0 THEN overlap / (len(v) - 4) ELSE 0.0 END AS p, CASE WHEN overlap > 0 THEN overlap / (len(w) - 4) ELSE 0.0 END AS r
  FROM h LEFT JOIN o USING (doc_id)),
s AS (SELECT *, CASE WHEN p > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, CASE WHEN n_chars < 1000 THEN 'simple' WHEN n_chars < 4000 THEN 'mid' ELSE 'hard' END AS level FROM pr)"""


def _self_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.whitespace_tokens("text")
    half = F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text", half.alias("half"))
    level = F.when(F.col("n_chars") < 1000, "simple").when(F.col("n_chars") < 4000, "mid").otherwise("hard")
    return metrics.rouge_scores(docs.withColumn("level", level), "doc_id", "text", "half", keep=["level"])


@query(f"WITH {_SELF} SELECT doc_id, round(f1, 6) AS f1, round(p, 6) AS p, round(r, 6) AS r, empty FROM s")
def rouge5_scores(spark, sf_dir):
    return _self_scores(spark, sf_dir).select("doc_id", *[F.round(c, 6).alias(c) for c in ("f1", "p", "r")], "empty")


@query(f"""WITH {_SELF} SELECT round(avg(f1), 6) AS f1_all, round(avg(p), 6) AS p_all, round(avg(r), 6) AS r_all,
  round(coalesce(avg(f1) FILTER (WHERE level = 'simple'), 0), 6) AS f1_simple, round(coalesce(avg(f1) FILTER (WHERE level = 'mid'), 0), 6) AS f1_mid,
  round(coalesce(avg(f1) FILTER (WHERE level = 'hard'), 0), 6) AS f1_hard, count(*) FILTER (WHERE empty) AS n_empty, count(*) AS n_scored FROM s""")
def report_by_level(spark, sf_dir):
    made = metrics.report_by_level(_self_scores(spark, sf_dir))
    return made.select(*[F.round(c, 6).alias(c) if c.startswith(("f1", "p_", "r_")) else F.col(c) for c in made.columns])


@query("""WITH s AS (SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'simple' WHEN n_chars < 4000 THEN 'mid' ELSE 'hard' END AS level, coalesce(CAST(quality AS DOUBLE), 0.0) AS f1, quality IS NULL AS empty
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT round(avg(f1), 6) AS f1_all, round(avg(f1) FILTER (WHERE level = 'simple'), 6) AS f1_simple, round(avg(f1) FILTER (WHERE level = 'mid'), 6) AS f1_mid,
  round(avg(f1) FILTER (WHERE level = 'hard'), 6) AS f1_hard, count(*) FILTER (WHERE empty) AS n_empty, count(*) AS n_scored FROM s""")
def report_with_missing(spark, sf_dir):
    """Pages without a score count as 0."""
    level = F.when(F.col("n_chars") < 1000, "simple").when(F.col("n_chars") < 4000, "mid").otherwise("hard").alias("level")
    quality = F.col("quality").cast("double")
    scores = table(spark, sf_dir, "labels").select("doc_id", quality.alias("f1"), quality.alias("p"), quality.alias("r"), F.lit(False).alias("empty"))
    made = metrics.report_by_level(metrics.with_missing(scores, table(spark, sf_dir, "documents").select("doc_id", level), "doc_id"))
    return made.select(*[F.round(c, 6).alias(c) if c.startswith("f1") else F.col(c) for c in made.columns if c not in ("p_all", "r_all")])


@query("""SELECT * FROM (VALUES ('ours', 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE), ('a', 0.84, 0.93, 0.823, 0.774), ('b', 0.865, 0.932, 0.875, 0.786)) AS r(method, f1_all, f1_simple, f1_mid, f1_hard)""")
def report_with_published(spark, sf_dir):
    """A report of our own among constants."""
    level = F.element_at(F.array(*map(F.lit, metrics.LEVELS)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    scores = table(spark, sf_dir, "nation").select(F.lit("ours").alias("method"), level.alias("level"), *[F.lit(0.5).alias(c) for c in ("f1", "p", "r")], F.lit(False).alias("empty"))
    return metrics.with_published(metrics.report_by_level(scores, by=["method"]), [("a", 0.84, 0.93, 0.823, 0.774), ("b", 0.865, 0.932, 0.875, 0.786)])


@query("""SELECT 'union' AS kind, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels)
UNION ALL SELECT 'common', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'difference', doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels)""")
def key_sets(spark, sf_dir):
    some, others = table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels")
    sets = [resume.set_of(kind, some, others, "doc_id").select(F.lit(kind).alias("kind"), "doc_id") for kind in ("union", "common", "difference")]
    return sets[0].unionByName(sets[1]).unionByName(sets[2])


@query("SELECT doc_id, source, CASE WHEN lang = 'en' THEN NULL ELSE n_chars * 2 END AS worked FROM documents")
def bypass_union(spark, sf_dir):
    """Rows that need no work go by, and meet the others again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return resume.with_bypass(docs, F.col("lang") == "en", lambda rows: rows.withColumn("worked", F.col("n_chars") * 2)).select("doc_id", "source", "worked")


@query("""SELECT count(*) AS n_pages, count(*) FILTER (WHERE lang IS NULL) AS n_failed, CAST(coalesce(sum(length(lang)), 0) AS BIGINT) AS n_chunks,
  CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS kept_bytes FROM documents""")
def run_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("markdown"), F.length("lang").alias("n_chunks"), F.when(F.col("lang").isNull(), "no language").alias("error"))
    return metrics.totals(docs)


@query(f"""WITH {_SELF}, b AS (SELECT * FROM (VALUES (0, 0.9::DOUBLE, 1.01::DOUBLE), (1, 0.8, 0.9), (2, 0.6, 0.8), (3, 0.4, 0.6), (4, 0.2, 0.4), (5, 0.0, 0.2)) AS b(bin, low, high))
SELECT bin, low, high, count(s.doc_id) AS n, round(count(s.doc_id) / (SELECT count(*) FROM s), 6) AS share FROM b LEFT JOIN s ON f1 >= low AND f1 < high GROUP BY bin, low, high""")
def f1_histogram(spark, sf_dir):
    return metrics.histogram(_self_scores(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("""SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS n, round(avg(quality) * 100, 6) AS clean_pct
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))""")
def clean_rate(spark, sf_dir):
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", "quality")
    return metrics.clean_rate(judged, "quality", "lang").withColumn("clean_pct", F.round("clean_pct", 6))


# -- pages ----------------------------------------------------------------------------------------------------

#: The texts of a page's blocks by its grammar: div.ad, h1, each p (their tags stripped), footer.
_ENTITIES = "replace(replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"
_PAGE_BLOCKS = rf"""pieces AS (
  SELECT page_id, html, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head,
    regexp_extract(html, '(?s)<footer>(.*)$', 1) AS foot, regexp_extract(html, '(?s)</h1>(.*?)</article>', 1) AS body FROM pages),
listed AS (SELECT page_id, list_concat([ad, head], (string_split(body, '<p>'))[2:], [foot]) AS parts FROM pieces),
blocks AS (SELECT page_id, k AS ord, trim(regexp_replace({_ENTITIES.format("regexp_replace(parts[k], '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS t FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM listed))"""


def _simplified(spark: SparkSession, sf_dir: str, *made: str) -> DataFrame:
    return with_simplified(table(spark, sf_dir, "pages").select("page_id", "html"), keep=("page_id", *made))


def _rebuilt(spark: SparkSession, sf_dir: str, classifier: str, *made: str) -> DataFrame:
    return with_all(table(spark, sf_dir, "pages").select("page_id", "html"), Config(classifier=classifier), ("page_id", *made))


@query("SELECT page_id, 3 + CAST(len(string_split(html, '<p>')) - 1 AS BIGINT) AS n_blocks FROM pages")
def simplify_block_count(spark, sf_dir):
    return _simplified(spark, sf_dir, "blocks").select("page_id", F.size("blocks").cast("long").alias("n_blocks"))


def _block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _simplified(spark, sf_dir, "blocks").select("page_id", F.inline("blocks"))
    bare = F.regexp_replace("html", "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return blocks.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), F.trim(bare).alias("block_text"))


@query(f"WITH {_PAGE_BLOCKS} SELECT page_id, CAST(ord AS BIGINT) AS ord, CASE WHEN length(t) > 500 THEN trim(substr(t, 1, 500)) || '...' ELSE t END AS block_text FROM blocks")
def simplify_block_text(spark, sf_dir):
    made = _block_text(spark, sf_dir)
    # A cut just behind a space leaves it before the ellipsis; both sides drop it.
    return made.withColumn("block_text", F.regexp_replace("block_text", r"\s+\.\.\.$", "..."))


#: What Markdown adds or escapes, and white space.
_BARE = r"[\s*#_`\\]+"


@query(rf"WITH {_PAGE_BLOCKS} SELECT page_id, md5(string_agg(regexp_replace(t, '{_BARE}', '', 'g'), '' ORDER BY ord)) AS digest FROM blocks GROUP BY page_id")
def markdown_text(spark, sf_dir):
    """All that the blocks say is in the Markdown, in order, and nothing else."""
    return markdown(spark, sf_dir).select("page_id", F.md5(F.regexp_replace("markdown", _BARE, "")).alias("digest"))


@query(rf"WITH {_PAGE_BLOCKS} SELECT page_id, md5(coalesce(string_agg(regexp_replace(t, '{_BARE}', '', 'g'), '' ORDER BY ord) FILTER (WHERE ord % 2 = 1), '')) AS digest FROM blocks GROUP BY page_id")
def main_text(spark, sf_dir):
    """The text of the blocks labelled main, here each second one, and of no other."""
    bare = F.regexp_replace("main_html", "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return main_html(spark, sf_dir).select("page_id", F.md5(F.regexp_replace(bare, _BARE, "")).alias("digest"))


@query(rf"""WITH n AS ({_NUMBERED}), s AS (
  SELECT page_id, string_split(regexp_replace(simplified, '(<[^<]*_item_id="\d+")', chr(1) || '\1', 'g'), chr(1)) AS parts FROM n),
b AS (SELECT page_id, trim(parts[k]) AS block FROM (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS k FROM s))
SELECT page_id, CAST(regexp_extract(block, '_item_id="(\d+)"', 1) AS BIGINT) AS item_id,
  CASE WHEN len(list_filter(regexp_split_to_array(block, '\s+'), lambda t: t <> '')) >= 40 THEN 'main' ELSE 'other' END AS label FROM b""")
def classify_blocks(spark, sf_dir):
    """Blocks to token ids, chunks of at most 512 tokens, batches of like length, scores at the separators, and labels again."""
    pages = _numbered(spark, sf_dir).select("page_id", T.extract_blocks("simplified").alias("blocks"))
    found = inference.classify_pages(pages, "page_id", "blocks", inference.TokenClassifier(model=_forty, max_tokens=512))
    rows = found.select("page_id", F.explode(F.arrays_zip("blocks", "predictions")).alias("b"))
    return rows.select("page_id", T.item_id(F.col("b.blocks")).cast("long").alias("item_id"), labels.label_of(F.col("b.predictions")).alias("label"))


def _forty() -> inference.Model:
    return inference.long_blocks(40)


@query("""SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda t: t <> '')) >= 100 THEN 1 ELSE 0 END AS label FROM documents""")
def text_quality(spark, sf_dir):
    """Texts through a classifier, here one that calls texts of a hundred words good; its budget of tokens is the reference's own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return inference.classify_texts(docs, "text", inference.TokenClassifier(model=_hundred)).select("doc_id", "label")


def _hundred() -> inference.Model:
    return inference.long_blocks(100)


#: A page that asks for one decision of simplification after the other; @ stands for the page's own words.
_RULES_PAGE = (
    '<html><body><div class="nav">n</div><p>@<br>@ 2</p><div style="display: none">z</div><ul><li>1 @<li>2<li>3<li>4 @</ul>'
    '<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl><script>var x = "@";</script><details><summary>s @</summary><p>closed</details>'
    "<details open><summary>o</summary><p>open @</details><table><caption>@</caption><tr><td>1</td></tr></table>"
    "<table><tr><td><div>@</div></td><td><div>right</div></td></tr></table><div>x @<p>y</p>x @</div><p>" + "word " * 150 + "</p>"
    '<img src="data:image/png;base64,AA" alt="pic"><section><p>a</p><p>@</p></section></body></html>'
)
_WORDS = "'Page ' || page_id"


def _rules_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.lit("Page "), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", F.replace(F.lit(_RULES_PAGE), F.lit("@"), words).alias("html"))


@query(f"""WITH t AS (SELECT page_id, {_WORDS} AS t FROM pages),
b AS (SELECT page_id, [t, t || ' 2', '1 ' || t || '...4 ' || t, 'a1...c3', 's ' || t, 'o', 'open ' || t, t || '1', t, 'right', 'x ' || t, 'y', rpad('', 500, 'word ') || '...', 'a', t] AS b FROM t)
SELECT page_id, CAST(unnest(range(1, len(b) + 1)) AS BIGINT) AS ord, regexp_replace(unnest(b), '\\s+[.]{{3}}$', '...') AS block_text FROM b""")
def simplify_rules(spark, sf_dir):
    """Breaks, hidden and removed elements, shortened lists, details, both kinds of tables, repeated runs, cut text: the blocks they make."""
    blocks = with_simplified(_rules_pages(spark, sf_dir), keep=("page_id", "blocks")).select("page_id", F.inline("blocks"))
    text = F.regexp_replace(F.trim(F.regexp_replace("html", "<[^>]*>", "")), r"\s+\.\.\.$", "...")
    return blocks.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), text.alias("block_text"))


@query(f"""WITH t AS (SELECT page_id, {_WORDS} AS t FROM pages)
SELECT page_id, '<html><body><p>' || t || '<br></p><ul _item_id="3"><li>1 ' || t || '</li><li>2</li><li>3</li><li>4 ' || t || '</li></ul><details><summary _item_id="5">s ' || t
  || '</summary></details><details open=""><p _item_id="7">open ' || t || '</p></details><table><tbody><tr><td><div _item_id="9">' || t
  || '</div></td></tr></tbody></table><div>x ' || t || '</div><p _item_id="13">' || repeat('word ', 150) || '</p><section><p _item_id="15">' || t || '</p></section></body></html>' AS main_html FROM t""")
def rebuild_rules(spark, sf_dir):
    """The same page with each second block kept: whole elements, their ancestors, and nothing of the others."""
    return with_all(_rules_pages(spark, sf_dir), Config(classifier="alternating"), ("page_id", "main_html"))


@query(f"""WITH t AS (SELECT page_id, {_WORDS} AS t FROM pages)
SELECT page_id, t || chr(10) || chr(10) || '  * 1 ' || t || chr(10) || '  * 2' || chr(10) || '  * 3' || chr(10) || '  * 4 ' || t || chr(10) || chr(10) || 's ' || t || chr(10) || chr(10)
  || 'open ' || t || chr(10) || chr(10) || t || chr(10) || chr(10) || 'x ' || t || chr(10) || chr(10) || trim(repeat('word ', 150)) || chr(10) || chr(10) || t AS markdown FROM t""")
def markdown_rules(spark, sf_dir):
    """And its Markdown."""
    made = with_all(_rules_pages(spark, sf_dir), Config(classifier="alternating"), ("page_id", "markdown"))
    return made.select("page_id", F.trim(F.regexp_replace("markdown", r"^\n+|\n+$", "")).alias("markdown"))


@query()
def simplify_pages(spark, sf_dir):
    return _simplified(spark, sf_dir, "simplified_html", "map_html", "error")


@query()
def main_html(spark, sf_dir):
    """Alternating labels, as parity tests use them."""
    return _rebuilt(spark, sf_dir, "alternating", "main_html", "error")


@query()
def markdown(spark, sf_dir):
    return _rebuilt(spark, sf_dir, "all-main", "markdown", "error")


@query()
def extract_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "n_blocks", "n_main", "n_other", "main_html", "markdown", "error")


@query()
def chunk_blocks(spark, sf_dir):
    """Pages to chunks: simplify, estimate each block's tokens, pack, one row per chunk."""
    pages = _simplified(spark, sf_dir, "blocks")
    costs = F.transform("blocks", lambda b: T.token_estimate(b["html"]).cast("int"))
    packed = pages.select("page_id", F.posexplode(pack(costs, max_tokens=512)).alias("chunk", "c"))
    return packed.select("page_id", "chunk", F.size("c.blocks").alias("n_blocks"), F.col("c.tokens").alias("n_tokens"))


@query()
def stream_extract(spark, sf_dir):
    """The pages as a file stream, until all that is there is done."""
    from .streaming.pages import extract_stream, page_stream

    schema = table(spark, sf_dir, "pages").schema
    target, checkpoint = new_table(spark, "stream"), new_table(spark, "stream-checkpoint")
    stream = page_stream(spark, f"{sf_dir}/pages.parquet*", schema)
    extract_stream(stream.select("page_id", "html"), target, checkpoint).awaitTermination()
    return spark.read.parquet(target).select("page_id", "n_blocks", "n_main", "n_other", "markdown", "error")


@query("SELECT page_id, 3 + CAST(len(string_split(html, '<p>')) - 1 AS BIGINT) AS n_blocks FROM pages")
def stream_block_count(spark, sf_dir):
    """Every page of the stream once, with its blocks."""
    return stream_extract(spark, sf_dir).select("page_id", "n_blocks")


# -- sources and sinks ----------------------------------------------------------------------------------------


@query("SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS line, md5(url) AS digest FROM pages")
def line_numbers(spark, sf_dir):
    """JSON lines in one file, read back with their line numbers over its splits."""
    target = new_table(spark, "lines")
    table(spark, sf_dir, "pages").select("page_id", "url").orderBy("page_id").coalesce(1).write.json(target)
    back = readers.numbered_lines(spark, target)
    return back.select(F.get_json_object("value", "$.page_id").cast("long").alias("page_id"), "line", F.md5(F.get_json_object("value", "$.url")).alias("digest"))


@query("SELECT page_id, url, md5(html) AS digest FROM pages")
def zstd_round_trip(spark, sf_dir):
    """JSON lines in zstd files, written by tasks and committed together, and read back."""
    target, given = new_table(spark, "zstd"), table(spark, sf_dir, "pages").select("page_id", "url", "html")
    sinks.zstd_json(given, target)
    return readers.json_lines(spark, readers.shards(spark, target), given.schema).select("page_id", "url", F.md5("html").alias("digest"))


@query("""SELECT page_id, '{"' || page_id || '":"main"}' AS labels, 'Seite ä ' || page_id AS markdown FROM pages""")
def json_results(spark, sf_dir):
    """Results as JSON lines, with characters beyond ASCII, and read back."""
    target, key = new_table(spark, "results"), F.col("page_id").cast("string")
    made = table(spark, sf_dir, "pages").select("page_id", F.create_map(key, F.lit("main")).alias("labels"), F.lit("<p>x").alias("main_html"), F.concat(F.lit("Seite ä "), key).alias("markdown"), F.lit(None).cast("string").alias("error"))
    sinks.json_results(made, target)
    back = spark.read.schema("page_id long, labels map<string,string>, html string, markdown string, error string").json(target)
    return back.where("html = '<p>x' AND error IS NULL").select("page_id", F.to_json("labels").alias("labels"), "markdown")
