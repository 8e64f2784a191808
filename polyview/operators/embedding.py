"""Embedding callables of the user inside Spark tasks: one model a worker, full batches, one bad image harms no other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models of this worker process, by the user's name for them.
_models: dict[str, Any] = {}


def model_of(name: str, load: Callable[[], Any]) -> Any:
    """The worker's model of that name, loaded at its first use and kept for all later tasks and queries of the process."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def _forward(model: Any, embed: Callable[[Any, list], np.ndarray], inputs: list) -> list[np.ndarray | Exception]:
    """An embedding or an error for every input.  A batch that fails is halved until the inputs that fail stand alone."""
    try:
        out = np.asarray(embed(model, inputs), np.float64)
        if out.ndim != 2 or len(out) != len(inputs):
            raise ValueError(f"{len(inputs)} inputs gave an array of shape {out.shape}")
        return list(out)
    except Exception as e:
        if len(inputs) == 1:
            return [e]
        half = len(inputs) // 2
        return _forward(model, embed, inputs[:half]) + _forward(model, embed, inputs[half:])


def embed_rows(rows: DataFrame, column: str, name: str, load: Callable[[], Any], prepare: Callable[[Any], Any], embed: Callable[[Any, list], np.ndarray], batch: int = 64, normalise: bool = True) -> DataFrame:
    """``rows`` with ``embedding`` (array of doubles, of unit length if ``normalise``) and ``error`` in place of the input column.

    ``prepare`` makes a model's input of a value (decode an image, say) and may raise; ``embed`` maps the model and a list of inputs to a
    matrix.  Inputs of several Arrow batches fill one batch, so every forward pass but a task's last has ``batch`` inputs.  A null value, one that
    cannot be prepared, and one on which the model fails or gives a number that is not finite, get an error, and the rows around them
    their embedding.  A vector of zeros stays as it is.  Rows come out in the order they went in.
    """
    kept = [c for c in rows.columns if c not in (column, "embedding", "error")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema] + ["embedding array<double>", "error string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # whose results are not all known
        results: list[list] = []  # of each held batch, a vector or error a row
        waiting: list[tuple[list, int, Any]] = []  # (results of its batch, row, input)

        def forward() -> None:
            part = waiting[:batch]
            del waiting[:batch]
            for (to, row, _), got in zip(part, _forward(model_of(name, load), embed, [x for *_, x in part])):
                if not isinstance(got, Exception) and not np.isfinite(got).all():
                    got = ValueError("the embedding is not finite")
                if normalise and not isinstance(got, Exception):
                    length = np.linalg.norm(got)
                    got = got / length if length > 0 else got
                to[row] = got

        def ready(all_of_them: bool) -> Iterator[pa.RecordBatch]:
            while held and (all_of_them or not any(x is None for x in results[0])):
                first, got = held.pop(0), results.pop(0)
                vectors = [None if isinstance(x, Exception) else x.tolist() for x in got]
                errors = [f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in got]
                yield pa.RecordBatch.from_arrays([*[first.column(c) for c in kept], pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[*kept, "embedding", "error"])

        for b in batches:
            got: list = [None] * b.num_rows
            held.append(b.select(kept))
            results.append(got)
            for row, value in enumerate(b.column(column)):
                value = value.as_py()
                try:
                    if value is None:
                        raise ValueError("no input")
                    waiting.append((got, row, prepare(value)))
                except Exception as e:
                    got[row] = e
                if len(waiting) >= batch:
                    forward()
            yield from ready(False)
        while waiting:
            forward()
        yield from ready(True)

    return rows.select(*kept, F.col(column)).mapInArrow(run, schema)
