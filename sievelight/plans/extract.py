"""The page pipeline: simplify, classify, rebuild, render. All of it is one Arrow stage that works on slices of bounded size; rows are moved
only to spread an input of few splits over all cores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import slices
from ..dom.rebuild import main_html
from ..dom.render import markdown, plain_text
from ..dom.simplify import CUTOFF, simplify
from ..functions.text import PROMPTS, visible_text
from ..operators.classify import Classifier, resolve

BLOCK = pa.struct([("ord", pa.int32()), ("item_id", pa.string()), ("html", pa.string()), ("content_type", pa.string())])
BLOCK_SQL = "array<struct<ord:int,item_id:string,html:string,content_type:string>>"


#: Markdown, the main HTML as it is, its text, or nothing; nothing, the page as it came, or its visible text.
OUTPUTS, FALLBACKS = ("markdown", "html", "text", "none"), ("none", "bypass", "text")


@dataclass(frozen=True)
class Config:
    """cutoff: characters of a block; classifier: a name, an .onnx path or a callable; empty_as_blank: "" instead of an empty shell
    for a page without labels; render: Markdown, or the cleaned HTML itself; output: what the column markdown holds, one of OUTPUTS; fallback:
    what pages with an error get, one of FALLBACKS; prompt and answers: version and form for generating models."""

    cutoff: int = CUTOFF
    classifier: str | Classifier = "heuristic"
    empty_as_blank: bool = False
    render: bool = True
    output: str = "markdown"
    fallback: str = "none"
    prompt: str = "v0"
    answers: str = "json"

    def __post_init__(self) -> None:
        for name, known in (("output", OUTPUTS), ("fallback", FALLBACKS), ("prompt", tuple(PROMPTS)), ("answers", ("json", "compact"))):
            if getattr(self, name) not in known:
                raise ValueError(f"unknown {name} {getattr(self, name)!r}; known: {', '.join(known)}")
        if self.cutoff < 1:
            raise ValueError("cutoff must be positive")
        if "compact" in self.prompt and self.answers != "compact":
            raise ValueError(f"the prompt {self.prompt} asks for compact answers")


Made = tuple[str, pa.DataType, str]


@dataclass(frozen=True)
class _Step:
    """makes, made from the columns in reads by work()(row) -> values. An error is a value."""

    reads: tuple[str, ...]
    makes: tuple[Made, ...]
    work: Callable[[], Callable[..., tuple[Any, ...]]]


def _through(pages: DataFrame, steps: list[_Step], keep: Sequence[str] | None = None) -> DataFrame:
    """pages through the steps in one Arrow stage, with what they make behind the other columns, as last made. keep: the columns that leave
    the stage; the steps read the others without their being copied to the next."""
    made: dict[str, Made] = {}
    needed: list[str] = []
    for step in steps:
        needed += [c for c in step.reads if c not in made and c not in needed]
        for one in step.makes:
            made.pop(one[0], None)
            made[one[0]] = one
    wanted = [c for c in pages.columns if c not in made and (keep is None or c in keep)]
    results = [m for m in made.values() if keep is None or m[0] in keep]
    given = pages.select(*[F.col(f"`{c}`") for c in [*wanted, *(c for c in needed if c not in wanted)]])
    schema = ", ".join([f"`{c}` {given.schema[c].dataType.simpleString()}" for c in wanted] + [f"`{n}` {sql}" for n, _, sql in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        applied = [(step.reads, [m[0] for m in step.makes], step.work()) for step in steps]
        for batch in batches:
            for part in slices(batch):
                columns = [part.column(c).to_pylist() for c in needed]
                cells: list[list[Any]] = [[] for _ in results]
                for row in zip(*columns):
                    values = dict(zip(needed, row))
                    for reads, makes, apply in applied:
                        values.update(zip(makes, apply(*[values[c] for c in reads])))
                    for cell, (name, _, _) in zip(cells, results):
                        cell.append(values[name])
                arrays = [pa.array(cell, kind) for cell, (_, kind, _) in zip(cells, results)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in wanted), *arrays], names=[*wanted, *[m[0] for m in results]])

    return given.mapInArrow(run, schema)


def spread(pages: DataFrame) -> DataFrame:
    """pages over all cores, where their input has fewer splits than there are: work on a page costs far more than moving it."""
    if pages.isStreaming:
        return pages
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(cores) if pages.rdd.getNumPartitions() < cores else pages


def _simplifying(config: Config) -> _Step:
    cutoff = config.cutoff

    def work():
        def one(html: str | None):
            try:
                page = simplify(html, cutoff)
            except Exception as error:  # errors are data
                return "", "", [], f"simplify failed: {error}"
            blocks = [{"ord": k, "item_id": b.item_id, "html": b.html, "content_type": b.content_type} for k, b in enumerate(page.blocks)]
            return page.simplified_html, page.map_html, blocks, None

        return one

    made = (("simplified_html", pa.string(), "string"), ("map_html", pa.string(), "string"), ("blocks", pa.list_(BLOCK), BLOCK_SQL), ("error", pa.string(), "string"))
    return _Step(("html",), made, work)


def _labelling(config: Config) -> _Step:
    classifier = config.classifier

    def work():
        classify = resolve(classifier)

        def one(blocks):
            blocks = blocks or []
            predicted = classify([b["html"] for b in blocks]) if blocks else []
            return ([(b["item_id"], "main" if k < len(predicted) and predicted[k] == 1 else "other") for k, b in enumerate(blocks)],)

        return one

    return _Step(("blocks",), (("labels", pa.map_(pa.string(), pa.string()), "map<string,string>"),), work)


def _rebuilding(config: Config) -> _Step:
    blank = config.empty_as_blank
    output = config.output if config.render else "html"

    def work():
        def one(map_html, labels, error):
            if error is not None:
                return "", "", error
            try:
                html = main_html(map_html, dict(labels or []), blank)
                return html, markdown(html) if output == "markdown" else html if output == "html" else plain_text(html) if output == "text" else "", None
            except Exception as failed:
                return "", "", f"reconstruct failed: {failed}"

        return one

    made = (("main_html", pa.string(), "string"), ("markdown", pa.string(), "string"), ("error", pa.string(), "string"))
    return _Step(("map_html", "labels", "error"), made, work)


def with_simplified(pages: DataFrame, config: Config = Config(), keep: Sequence[str] | None = None) -> DataFrame:
    """pages (html) with simplified_html, map_html, blocks and error, or those in keep; a page that fails has an error and no blocks."""
    return _through(spread(pages), [_simplifying(config)], keep)


def with_labels(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """pages (blocks) with labels: a map from item_id to main or other."""
    return _through(pages, [_labelling(config)])


def with_content(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """pages (map_html, labels, error) with main_html and markdown; rows with an error keep it and have neither."""
    return _through(pages, [_rebuilding(config)])


def with_all(pages: DataFrame, config: Config = Config(), keep: Sequence[str] | None = None) -> DataFrame:
    """pages (html) through the three of them in one stage: what only the next needs, such as the marked page, is held for one page at a time."""
    return _through(spread(pages), [_simplifying(config), _labelling(config), _rebuilding(config)], keep)


def with_text(pages: DataFrame) -> DataFrame:
    """pages (map_html, labels) with text for scoring: links and images left out, "" for a page without main blocks or with a failure."""

    def work():
        def one(map_html, labels):
            try:
                known = dict(labels or [])
                return (plain_text(main_html(map_html, known)) if "main" in known.values() else "",)
            except Exception:  # a page that can't be rebuilt scores as empty
                return ("",)

        return one

    return _through(pages, [_Step(("map_html", "labels"), (("text", pa.string(), "string"),), work)])


def extract(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """pages (html and any other columns, which are kept) with labels, n_blocks, n_main, n_other, main_html, markdown, error.

    Simplifying, labelling and rebuilding a page are one Arrow stage; no rows move."""
    unread = () if config.fallback != "none" else ("html",)
    done = with_all(pages, config, [c for c in pages.columns if c not in unread] + ["labels", "main_html", "markdown", "error"])
    if config.fallback != "none":
        instead = F.col("html") if config.fallback == "bypass" else visible_text("html")
        done = done.withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(F.coalesce(instead, F.lit(""))) for c in ("main_html", "markdown")})
    main = F.size(F.map_filter("labels", lambda _, v: v == "main")).cast("long")
    counted = done.withColumn("n_blocks", F.size("labels").cast("long")).withColumn("n_main", main).withColumn("n_other", F.col("n_blocks") - F.col("n_main"))
    return counted.drop("simplified_html", "map_html", "blocks", "html")


def from_simplified(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """The same for pages that come simplified (simplified_html, and map_html or else that itself)."""
    from ..functions.text import extract_blocks, item_id

    pieces = F.transform(extract_blocks("simplified_html"), lambda b, k: F.struct(k.alias("ord"), item_id(b).alias("item_id"), b.alias("html"), F.lit(None).cast("string").alias("content_type")))
    ready = pages.withColumn("map_html", F.coalesce("map_html", "simplified_html") if "map_html" in pages.columns else F.col("simplified_html"))
    ready = ready.withColumn("blocks", pieces).withColumn("error", F.lit(None).cast("string"))
    return with_content(with_labels(ready, config), config)


def with_given_labels(pages: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """pages with labels from a table (key, item_id, label), the mode for predictions made elsewhere."""
    maps = labels.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("item_id").cast("string").alias("k"), "label"))).alias("labels"))
    return pages.join(maps, key, "left").withColumn("labels", F.coalesce("labels", F.create_map().cast("map<string,string>")))
