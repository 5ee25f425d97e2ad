"""JSON inside strings: lenient and strict parsing, type tags, key sets, salvage, payloads."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def parse_object(text: Column) -> Column:
    """The object as map<string,string> (nested values as JSON text); null for anything else."""
    return F.from_json(F.when(text.rlike(r"(?s)^\s*\{.*\}\s*$"), text), "map<string,string>", {"allowSingleQuotes": "false"})


def _no_duplicates(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def strict_error(text: str | None) -> str | None:
    """Why a text is not exactly one JSON value without duplicate keys at any depth; None if it is."""
    if text is None:
        return "not_a_string"
    try:
        json.loads(text, object_pairs_hook=_no_duplicates)
    except json.JSONDecodeError as e:
        return "trailing_data" if e.msg == "Extra data" else "invalid_json"
    except (ValueError, RecursionError) as e:
        return "duplicate_key" if "duplicate" in str(e) else "invalid_json"
    return None


@F.pandas_udf(StringType())
def strict_json_error(text: pd.Series) -> pd.Series:
    return pd.Series([strict_error(t) for t in text], dtype=object)


def lenient_object(text: str | None) -> str | None:
    """The object in a model's output: fences dropped, whole text, else first "{" to last "}"."""
    if text is None:
        return None
    bare = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text.strip(), flags=re.I)
    for candidate in (bare, bare[bare.find("{") : bare.rfind("}") + 1]):
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return None


@F.pandas_udf(StringType())
def extract_object(text: pd.Series) -> pd.Series:
    return pd.Series([lenient_object(t) for t in text], dtype=object)


def json_type(text: Column) -> Column:
    """null, boolean, string, list, object or number of one JSON value; null if it does not parse."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(kind == "VOID", "null").when(kind == "BOOLEAN", "boolean").when(kind == "STRING", "string").when(F.startswith(kind, F.lit("ARRAY")), "list").when(F.startswith(kind, F.lit("OBJECT")), "object").when(kind.isNotNull(), "number")


def key_difference(text: Column, expected: list[str]) -> Column:
    """Keys that are missing or unexpected, sorted; empty if the key set is exact."""
    keys, wanted = F.array_distinct(F.json_object_keys(text)), F.array(*map(F.lit, expected))
    return F.array_sort(F.concat(F.array_except(keys, wanted), F.array_except(wanted, keys)))


_OPEN = r'["“]'
_CLOSE = r'["”]'
_ACTION = rf"(?i)^\s*(?:```(?:json)?\s*)?\{{\s*{_OPEN}action{_CLOSE}\s*:\s*{_OPEN}(ask|summarize)(?:{_CLOSE}|(?=\s*[,}}]))"


def closed_action(text: Column) -> Column:
    """ask or summarize of a model's output, from the object or, if broken, from its very beginning."""
    parsed = F.get_json_object(F.when(F.try_parse_json(text).isNotNull(), text), "$.action")
    return F.coalesce(F.when(parsed.isin("ask", "summarize"), parsed), F.nullif(F.lower(F.regexp_extract(text, _ACTION, 1)), F.lit("")))


def salvaged_findings(text: Column) -> Column:
    """Strings of the key_findings array, read from the array alone where the object is broken."""
    array = F.regexp_extract(text, rf"(?i){_OPEN}key_findings{_CLOSE}\s*:\s*(\[[\s\S]*?\])", 1)
    whole = F.from_json(array, "array<string>")
    tokens = F.transform(F.regexp_extract_all(array, F.lit(r'"((?:\\.|[^"\\])*)"'), F.lit(1)), lambda x: x)
    return F.when(array == "", F.array().cast("array<string>")).otherwise(F.coalesce(whole, tokens))


def literal_findings(user: Column, output: Column) -> Column:
    """Distinct salvaged findings that stand literally in the user's text; the text itself without one."""
    found = F.array_distinct(F.filter(F.transform(salvaged_findings(output), lambda f: F.trim(f)), lambda f: (f != "") & F.contains(user, f)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(user))


def pick_answer(text: Column) -> Column:
    """answer, message or recommendation of a JSON object, the first that is not empty; else the text."""
    fields = [F.nullif(F.get_json_object(text, f"$.{k}"), F.lit("")) for k in ("answer", "message", "recommendation")]
    return F.coalesce(*fields, text)


def normalize_questions(value: str | None, most: int = 3) -> list[str]:
    """A string, object or list as at most three stripped, nonempty questions."""
    try:
        v = json.loads(value) if value is not None else None
    except ValueError:
        v = value
    items = [v] if isinstance(v, str | dict) else v if isinstance(v, list) else []
    texts = [next((x[k] for k in ("question", "text", "value") if x.get(k)), "") if isinstance(x, dict) else x for x in items]
    return [t for t in (str(x).strip() for x in texts if x is not None) if t][:most]


@F.pandas_udf(ArrayType(StringType()))
def questions_column(value: pd.Series) -> pd.Series:
    return pd.Series([normalize_questions(v) for v in value], dtype=object)


def ask_payload(questions: Column) -> Column:
    return F.to_json(F.struct(F.lit("ask").alias("action"), F.lit("initial").alias("stage"), F.lit(False).alias("complete"), questions.alias("questions")))


def summary_payload(findings: Column, tendency: str, note: str) -> Column:
    return F.to_json(F.struct(F.lit("summarize").alias("action"), F.lit("summary").alias("stage"), F.lit(True).alias("complete"), findings.alias("key_findings"), F.lit(tendency).alias("syndrome_tendency"), F.array().cast("array<string>").alias("need_more_info"), F.lit(note).alias("note")))


ASK_FIELDS = ["action", "stage", "complete", "questions"]
SUMMARY_FIELDS = ["action", "stage", "complete", "key_findings", "syndrome_tendency", "need_more_info", "note"]


def contract_error(text: str | None) -> str | None:
    """First violation of the closed contract of an assistant payload; None if it holds."""
    if (error := strict_error(text)) is not None:
        return error
    v = json.loads(text)
    if not isinstance(v, dict):
        return "not_an_object"
    label = (v.get("action"), v.get("stage"))
    fields, complete = {("ask", "initial"): (ASK_FIELDS, False), ("summarize", "summary"): (SUMMARY_FIELDS, True)}.get(label, (None, None))
    if fields is None:
        return "label"
    if set(v) != set(fields):
        return "fields"
    if v["complete"] is not complete:
        return "complete"
    lists = {"questions": (1, 3)} if fields is ASK_FIELDS else {"key_findings": (0, None), "need_more_info": (0, None)}
    for name, (least, most) in lists.items():
        x = v[name]
        if not isinstance(x, list) or len(x) < least or (most is not None and len(x) > most) or any(not isinstance(i, str) or not i.strip() for i in x) or len({i.strip() for i in x}) != len(x):
            return name
    for name in ("syndrome_tendency", "note"):
        if name in v and (not isinstance(v[name], str) or not v[name].strip()):
            return name
    return None


@F.pandas_udf(StringType())
def contract_error_column(text: pd.Series) -> pd.Series:
    return pd.Series([contract_error(t) for t in text], dtype=object)
