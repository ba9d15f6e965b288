"""Detectors that native expressions cannot say, as vectorised functions over Arrow arrays.

A function takes the names and the descriptions of a batch as Arrow string arrays and returns a
struct array ``severity, matched, evidence``.  All registered functions are evaluated in one pass of
Arrow batches in front of the native detectors; their results are plain columns by then, so a
text goes to Python once however many detectors, filters and scores refer to them.

Names and descriptions arrive without NULLs (``unknown`` and the empty text).  A function that
returns NULL for a row says that nothing matched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from toolwarden.operators.detectors import detection, normalise_tools, with_detections

FOUND = "severity INT, matched BOOLEAN, evidence STRING"
ArrowDetector = Callable[[pa.Array, pa.Array], pa.Array]


def found(severity: Iterable[int], matched: Iterable[bool], evidence: Iterable[str]) -> pa.StructArray:
    """The result of a detector from its three fields."""
    columns = [pa.array(severity, pa.int32()), pa.array(matched, pa.bool_()), pa.array(evidence, pa.string())]
    return pa.StructArray.from_arrays(columns, ["severity", "matched", "evidence"])


def with_all_detections(
    tools: DataFrame, arrow: dict[str, ArrowDetector], enabled: Iterable[str] | None = None,
    column: str = "detections", **options,
) -> DataFrame:
    """``detections`` of the native detectors, then those of the Arrow functions by name, in their order."""
    steps = {f"_arrow_{i}": arrow_udf(function, FOUND)("tool_name", "description") for i, function in enumerate(arrow.values())}
    extra = dict(options.pop("extra", None) or {})
    for step, name in zip(steps, arrow, strict=True):
        matched = F.coalesce(F.col(f"{step}.matched"), F.lit(False))
        severity, evidence = F.coalesce(F.col(f"{step}.severity"), F.lit(0)), F.coalesce(F.col(f"{step}.evidence"), F.lit(""))
        extra[name] = lambda *_, n=name, m=matched, s=severity, e=evidence: detection(n, m, s, e)
    prepared = normalise_tools(tools).withColumns(steps)
    return with_detections(prepared, enabled, extra, column, **options).drop(*steps)


#: Runs of so many signs without a break are looked at, and reported beyond so many bits a sign.
RANDOM_RUN, RANDOM_BITS, RANDOM_SEVERITY = 24, 3.5, 45
_RUN = re.compile(r"[A-Za-z0-9_+/=-]{%d,}" % RANDOM_RUN)


def entropy(run: str) -> float:
    """Bits a sign of a run by the frequencies of its own signs."""
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values())


def random_runs(names: pa.Array, descriptions: pa.Array) -> pa.Array:
    """Long runs that look drawn at random, such as keys and encoded data; evidence is their number and
    the first one's length."""
    hits = [[r for r in _RUN.findall(text) if entropy(r) > RANDOM_BITS] for text in descriptions.to_pylist()]
    evidence = [f"{len(h)} run(s), first of {len(h[0])}" if h else "" for h in hits]
    return found([RANDOM_SEVERITY] * len(hits), [bool(h) for h in hits], evidence)
