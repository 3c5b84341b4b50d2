"""JSON paths over VARIANT: keys, indices from either end, wildcards, and errors as values.

A path is compiled once into column expressions; each step goes from one VARIANT to the next, so nothing leaves the JVM. Where a
step does not apply the result says why and has no value, rather than null that could be a JSON null.

Defined cases: a null text, or one that is no JSON, is "not JSON"; an empty path is the whole text; JSON nulls are values.
After [*] a key is read from every element that is an object and has it, the others fall away. Keys of objects come out in the order that VARIANT
keeps them in, by name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = re.compile(r"""\.(?P<key>[^.\[]+)|\.?\[\s*(?:(?P<all>\*)|(?P<index>[+-]?\d+)|"(?P<double>[^"\]]*)"|'(?P<single>[^'\]]*)')\s*\]""")
RESULT = "struct<value:variant,error:string>"


def compiled(path: str) -> list[str | int | None] | None:
    """Steps of a path: a key, an index, or None for all elements; None if the path can't be read."""
    steps, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            return None
        if m["all"]:
            steps.append(None)
        elif m["index"]:
            steps.append(int(m["index"]))
        else:
            steps.append(next(g for g in (m["key"], m["double"], m["single"]) if g is not None))
        at = m.end()
    return steps


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _step(now: Column, step: str | int | None, spread: bool) -> Column:
    """struct<value, error> after one more step."""
    found = lambda value: F.struct(value.alias("value"), F.lit(None).cast("string").alias("error")).cast(RESULT)
    failed = lambda text: F.struct(F.lit(None).cast("variant").alias("value"), F.lit(text).alias("error")).cast(RESULT)
    v = now["value"]
    array = _elements(v)
    if step is None:
        out = F.when(array.isNotNull(), found(v)).otherwise(failed("[*] requires array"))
    elif isinstance(step, int):
        at = F.size(array) + step if step < 0 else F.lit(step)
        out = F.when(array.isNull(), failed(f"[{step}] requires array")).when((at < 0) | (at >= F.size(array)), failed(f"Index {step} out of bounds")).otherwise(found(F.get(array, at)))
    else:
        member = F.try_element_at(_members(v), F.lit(step))
        has = F.map_contains_key(_members(v), F.lit(step))
        out = F.when(_members(v).isNull(), failed(f"Can't read .{step} from non-object")).when(has, found(member)).otherwise(failed(f'Key "{step}" not found'))
        if spread:
            inner = F.filter(F.transform(array, lambda x: F.try_element_at(_members(x), F.lit(step))), lambda x: x.isNotNull())
            out = F.when(array.isNotNull(), found(F.to_variant_object(inner))).otherwise(out)
    return F.when(now["error"].isNotNull(), now).otherwise(out)


def json_path(text: Column, path: str) -> Column:
    """struct<value: JSON text, error>: exactly one of the two is not null."""
    said = lambda value, error: F.struct(value.cast("string").alias("value"), error.cast("string").alias("error"))
    path = path.strip()
    if path and not path.startswith("$"):
        return said(F.lit(None), F.lit("JSONPath must start with $"))
    steps = compiled(path)
    if steps is None:
        return said(F.lit(None), F.lit("Couldn't parse JSONPath"))
    parsed = F.try_parse_json(text)
    now = F.struct(parsed.alias("value"), F.when(parsed.isNull(), "not JSON").alias("error")).cast(RESULT)
    spread = False
    for step in steps:
        now = F.transform(F.array(now), _after(step, spread))[0]
        spread = spread or step is None
    return F.transform(F.array(now), lambda r: said(F.when(r["error"].isNull(), F.to_json(r["value"])), r["error"]))[0]


def _after(step: str | int | None, spread: bool):
    return lambda now: _step(now, step, spread)
