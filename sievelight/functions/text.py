"""Column functions on markup, text and token lists. All stay inside Catalyst; no Python runs for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dom.render import SPACER_IMAGE

#: Characters of visible text kept, and elements without visible text.
VISIBLE_CHARS = 5000
_INVISIBLE = "script|style|noscript"


def visible_text(html: Column | str, limit: int = VISIBLE_CHARS) -> Column:
    """The text between tags without scripts and styles, white space collapsed, cut to limit characters."""
    html = F.col(html) if isinstance(html, str) else html
    bare = F.regexp_replace(html, rf"(?is)<({_INVISIBLE})\b[^>]*>.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, limit)


def domain(url: Column | str) -> Column:
    """The authority of a URL in lower case (with user and port), "" if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def strip_xml_declaration(html: Column | str) -> Column:
    return F.regexp_replace(html, r"(?s)<\?xml\s+.*?\??>", "")


def strip_spacer_images(html: Column | str) -> Column:
    return F.regexp_replace(html, SPACER_IMAGE, "")


def extract_blocks(simplified: Column | str) -> Column:
    """The pieces of simplified HTML, each from the tag with its _item_id to the next; what stands before is dropped."""
    parts = F.split(F.regexp_replace(simplified, r'(<[^<]*_item_id="\d+")', "\x01$1"), "\x01")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))


def item_id(block: Column) -> Column:
    """The id of one block, null if it has none."""
    return F.nullif(F.regexp_extract(block, r'_item_id="(\d+)"', 1), F.lit(""))


def item_ids(html: Column | str) -> Column:
    """All ids of a document, as integers, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r'_item_id="(\d+)"'), F.lit(1)), lambda x: x.cast("long"))


def insert_block_markers(simplified: Column | str, marker: str = "[BLOCK]") -> Column:
    return F.regexp_replace(simplified, r'(_item_id="\d+")', f"{marker} $1")


def whitespace_tokens(text: Column | str) -> Column:
    parts = F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)\s+")
    return F.filter(parts, lambda t: t != "")


def token_estimate(text: Column | str) -> Column:
    """A length estimate without a tokenizer: a quarter of the characters, plus one."""
    return (F.floor(F.length(text) / 4) + 1).cast("long")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces; none if there are fewer tokens."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def short_source(src: Column) -> Column:
    """A URL of more than ten characters as its first and last five."""
    return F.when(F.length(F.url_encode(src)) <= 10, src).otherwise(F.concat(F.left(src, F.lit(5)), F.lit("..."), F.right(src, F.lit(5))))


def compact_labels(response: Column | str) -> Column:
    """An array of (item_id, label) from text such as 1main2other."""
    found = F.regexp_extract_all(response, F.lit(r"(\d+(?:main|other))"), F.lit(1))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).alias("item_id"), F.regexp_extract(x, r"[a-z]+$", 0).alias("label")))


def response_labels(response: Column | str) -> Column:
    """An array of (item_id, label) from a model's answer: JSON, also one that is cut off, and else the compact form."""
    found = F.regexp_extract_all(response, F.lit(r'("\d+"\s*:\s*"(?:main|other)")'), F.lit(1))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\d+", 0).alias("item_id"), F.regexp_extract(x, r"(main|other)", 1).alias("label")))
    return F.when(F.size(pairs) > 0, pairs).otherwise(compact_labels(response))


#: Instructions to put before a page's blocks, by version; our own wording.
PROMPTS = {
    "v0": 'Every block of the page below has an id. Say for each whether it is main content or not, as JSON such as {"1": "main", "2": "other"}.\n\n',
    "v1": "Below is a page whose blocks are numbered by their _item_id. Menus, advertisements, footers and links to other pages are other; what a reader "
    'comes for is main. Answer with JSON only: {"1": "main", "2": "other"}.\n\n',
    "v2": "Decide for each numbered block of this page: main if it belongs to the article, its headings, tables and lists or the comments on it, else other. "
    'Answer with one JSON object that has every id: {"1": "main", "2": "other"}.\n\n',
    "compact": "Every block of the page below has an id. Say for each whether it is main content or not, such as 1main2other.\n\n",
    "short_compact": "Label each block main or other, such as 1main2other.\n\n",
}


def prompt(simplified: Column | str, version: str = "v0") -> Column:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version {version!r}; known: {', '.join(PROMPTS)}")
    return F.concat(F.lit(PROMPTS[version]), simplified)


#: What an error can begin with: the stage that failed.
FAILING_STAGES = ("input", "open", "read", "simplify", "classify", "answer", "reconstruct", "render")


def failed_stage(error: Column | str) -> Column:
    """The stage that an error names, "other" if it names none, null without an error."""
    given = F.col(error) if isinstance(error, str) else error
    stage = F.regexp_extract(given, f"^({'|'.join(FAILING_STAGES)}) failed: ", 1)
    return F.when(given.isNotNull(), F.when(stage == "", "other").otherwise(stage))


def fits_context(tokens: Column, context: int, reserve: int = 1000) -> Column:
    """Whether a prompt leaves the reserve for the answer."""
    return tokens <= context - reserve


def dummy_response(ids: Column, compact: bool = True) -> Column:
    """The answer in which every block is other, for length budgets."""
    if compact:
        return F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit("other"))), "")
    body = F.array_join(F.transform(ids, lambda i: F.concat(F.lit('"'), i.cast("string"), F.lit('": "other"'))), ", ")
    return F.concat(F.lit("{"), body, F.lit("}"))


def guided_pattern(ids: Column) -> Column:
    """A regular expression that an answer over these ids must match."""
    return F.concat(F.lit(r"<answer>\s*"), F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit("(main|other)"))), ""), F.lit(r"\s*</answer>"))
