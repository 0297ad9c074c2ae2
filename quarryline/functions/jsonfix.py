"""JSON out of free text: fences, brackets, commas; a schema subset."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def outermost(text: str) -> str:
    """From the first bracket to the one that closes it, strings respected; the rest if none does."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return text
    opening = text[start]
    closing = {"{": "}", "[": "]"}[opening]
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|$)|[\[\]{}]', text[start:], re.S):
        depth += (m[0] == opening) - (m[0] == closing)
        if depth == 0 and m[0] == closing:
            return text[start : start + m.end()]
    return text[start:]


def repair(raw: str) -> tuple[Any, str, str | None]:
    """(value, cleaned text, error)."""
    fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", raw.strip(), re.S)
    text = outermost((fenced[1] if fenced else raw).strip())
    text = re.sub(r",\s*([}\]])", r"\1", text)
    try:
        return json.loads(text), text, None
    except ValueError as e:
        return None, text, str(e)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
    if kind == "number":
        return not isinstance(value, bool) and isinstance(value, int | float)
    return isinstance(value, _TYPES[kind])


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What is wrong by type, enum, const, required, properties, additionalProperties, items, and the common bounds."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in own:
                out += violations(v, own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list):
        if isinstance(schema.get("items"), dict):
            out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: bounds")
    return out


def repaired(raw: Column, schema: dict | None = None) -> Column:
    """struct(json, error): the repaired text, or what is wrong with it."""

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, "null"
        value, clean, error = repair(text)
        if error is None and schema is not None:
            error = "; ".join(violations(value, schema)) or None
        return (clean if error is None else None), error

    @F.pandas_udf("struct<json:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])

    return run(raw)


def outline(prompt: str) -> str:
    """The default completion, deterministic: the first line of the content as title, its first 200 characters as summary."""
    content = prompt.rpartition("\n\n")[2].strip() or prompt.strip()
    return json.dumps({"title": content.split("\n")[0][:120], "summary": content[:200]})


def extract(markdown: str, schema: dict, complete: Callable[[str], str] = outline, budget: int = 32_000) -> tuple[str | None, str | None]:
    """(json, error): content within a budget, its delimiters escaped, completed, repaired and validated; one retry that names what was wrong."""
    from .text import truncate_markdown

    body = re.sub(r"(?i)<(/?untrusted_webpage_content)>", r"&lt;\1&gt;", truncate_markdown(markdown or "", budget)[0])
    note = ""
    for _ in range(2):
        value, clean, error = repair(complete(f"Schema: {json.dumps(schema)}\n{note}\n\n{body}"))
        error = error or "; ".join(violations(value, schema)) or None
        if error is None:
            return clean, None
        note = f"The last answer was wrong: {error}"
    return None, error


def extracted(markdown: Column, schema: dict, complete: Callable[[str], str] = outline, budget: int = 32_000) -> Column:
    """struct(json, error) by :func:`extract`; ``complete`` is any function of a prompt."""

    @F.pandas_udf("struct<json:string,error:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(t or "", schema, complete, budget) for t in texts], columns=["json", "error"])

    return run(markdown)
