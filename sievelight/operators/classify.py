"""Block classifiers. A classifier gets the blocks of one page and says 1 (main) or 0 (other) for each.

The default weighs text length, link density and class names, as published boilerplate detectors do. It is a stand-in without
a trained model's quality. `labels` mode takes predictions from a table instead; any callable can be registered by name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Classifier = Callable[[list[str]], list[int]]

#: Least characters of a text block; most characters in links; words that name page furniture.
MIN_CHARS, MAX_LINKS = 25, 0.4
_FURNITURE = re.compile(r"\b(ad|ads|advert|banner|footer|menu|nav|promo|share|sidebar|social|sponsor|comment-form|cookie)\b", re.IGNORECASE)
_OPEN = re.compile(r'^<(\w+)([^>]*)>')
_LINK = re.compile(r"<a\b[^>]*>(.*?)</a>", re.DOTALL | re.IGNORECASE)
_TAG = re.compile(r"<[^>]+>")


def heuristic(blocks: list[str]) -> list[int]:
    made = []
    for block in blocks:
        head = _OPEN.match(block)
        tag, attrs = (head[1].lower(), head[2]) if head else ("", "")
        text = _TAG.sub("", block).strip()
        linked = sum(len(_TAG.sub("", x)) for x in _LINK.findall(block))
        heading = re.fullmatch("h[1-6]", tag) is not None
        enough = heading and text or len(text) >= MIN_CHARS
        made.append(int(bool(enough) and tag != "footer" and linked <= MAX_LINKS * max(1, len(text)) and not _FURNITURE.search(attrs)))
    return made


_KNOWN: dict[str, Classifier] = {"heuristic": heuristic, "all-main": lambda blocks: [1] * len(blocks), "alternating": lambda blocks: [1 - k % 2 for k in range(len(blocks))]}


def register(name: str, classifier: Classifier) -> None:
    _KNOWN[name] = classifier


def resolve(name: str | Classifier) -> Classifier:
    """A registered classifier, a callable itself, or an ONNX file whose path is given."""
    if callable(name):
        return name
    if name in _KNOWN:
        return _KNOWN[name]
    if name.endswith(".onnx"):
        return onnx(name)
    raise ValueError(f"unknown classifier {name!r}; known: {', '.join(sorted(_KNOWN))}, or the path of an .onnx file")


def onnx(path: str) -> Classifier:
    """A model with one input, the blocks as strings, and one output, a number for each; loaded once per worker."""
    session = None

    def classify(blocks: list[str]) -> list[int]:
        nonlocal session
        if session is None:
            import onnxruntime

            session = onnxruntime.InferenceSession(path)
        import numpy as np

        out = session.run(None, {session.get_inputs()[0].name: np.array(blocks, object)})[0]
        return [int(round(float(x))) for x in np.ravel(out)]

    return classify


class Backend(Protocol):
    """A generating model: made once for each Python worker, and given some prompts at a time."""

    def generate(self, prompts: list[str]) -> list[str]: ...


def answers(pages: DataFrame, prompt: str, make: Callable[[], Backend], batch: int = 32, attempts: int = 3) -> DataFrame:
    """pages with answer and answer_error: what a backend says to the prompts in a column. Some prompts that fail attempts times are asked one
    by one, and one that still fails has an empty answer and an error; a null prompt isn't asked."""
    schema = pages.withColumn("answer", F.lit("")).withColumn("answer_error", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make()

        def ask(prompts: list[str]) -> tuple[list[str], list[str | None]]:
            failed = ""
            for _ in range(attempts):
                try:
                    said = backend.generate(prompts)
                    if len(said) != len(prompts):
                        raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
                    return list(said), [None] * len(said)
                except Exception as error:  # errors are data
                    failed = f"answer failed: {error}"
            if len(prompts) == 1:
                return [""], [failed]
            each = [ask([p]) for p in prompts]
            return [a[0] for a, _ in each], [e[0] for _, e in each]

        for rows in batches:
            prompts = rows.column(prompt).to_pylist()
            said, errors = [""] * len(prompts), [None] * len(prompts)
            some = [k for k, p in enumerate(prompts) if p is not None]
            for lo in range(0, len(some), batch):
                own = some[lo : lo + batch]
                for k, answer, error in zip(own, *ask([prompts[k] for k in own])):
                    said[k], errors[k] = answer, error
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string()), pa.array(errors, pa.string())], names=[*rows.schema.names, "answer", "answer_error"])

    return pages.mapInArrow(run, schema)
