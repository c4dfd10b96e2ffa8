"""Replies and contracts: JSON out of replies, templates as check expressions, the branch a reply takes."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# fixed values: actions, identity fields and contracts of the protocol
ACTIONS = ("read_page", "read_chatlog", "read_memo", "write_memo", "publish", "help")
IDENTITY = {"title": "", "category": "", "summary": "", "tags": [], "language": [], "confidence": 0.0}
CONTRACTS: dict[str, dict] = {
    "session_actions": {"template": {"action": "", "page": None, "memo": None, "identity": None}, "enums": {"action": list(ACTIONS)}},
    "chatlog_summary": {"template": {"summary": ""}},
}


def json_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}`` of a reply; null without them."""
    cut = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(cut != "", cut)


@F.pandas_udf(StringType())
def strict_json(text: pd.Series) -> pd.Series:
    """Canonical JSON of texts that are exactly one JSON object; null for anything else."""

    def parse(t: str | None) -> str | None:
        try:
            value = json.loads(t) if t is not None else None
        except (ValueError, RecursionError):
            return None
        return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None

    return text.map(parse)


def reply_json(text: Column) -> Column:
    """The object a reply holds, as canonical JSON; null if there is none."""
    return strict_json(json_slice(text))


def _kind(doc: Column, path: str) -> Column:
    """Type name of the value at a JSON path: BOOLEAN, BIGINT, DOUBLE, STRING, ARRAY<..>, OBJECT<..>, VOID; null if missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))


_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT)"


def _slot(want: Any) -> tuple[str, str] | None:
    """Pattern of the types that fill an empty template value and what a problem says; None for a value that is fixed."""
    if isinstance(want, dict):
        return "^OBJECT", "expected object"
    if want is None:
        return "", ""
    if isinstance(want, bool):
        return None
    if want == "":
        return "^STRING$", "expected string"
    if want == []:
        return "^ARRAY", "expected list"
    return (_NUMBER, "expected number") if want == 0 else None


def _equals(doc: Column, path: str, kind: Column, want: Any) -> Column:
    """Whether the value at a path is this one, of this type; numbers compare by value, whole or not."""
    got = F.get_json_object(doc, path)
    if isinstance(want, bool):
        return (kind == "BOOLEAN") & (got == str(want).lower())
    if isinstance(want, (int, float)):
        return (kind.rlike(_NUMBER) & (got.try_cast("double") == float(want))) | ((kind == "BOOLEAN") & F.lit(want == 1) & (got == "true"))  # true equals 1
    if isinstance(want, str):
        return (kind == "STRING") & (got == want)
    same = F.to_json(F.try_parse_json(got)) == F.to_json(F.parse_json(F.lit(json.dumps(want))))
    return kind.startswith("ARRAY") & same


def check_template(doc: Column, template: dict[str, Any]) -> Column:
    """Array of problems of a JSON object against a template: an object's own keys in the template's order, its unknown
    keys behind them, and so for each object within, in its place.

    Empty values are typed slots, null takes anything, other values must be equal and of the same type; objects nest.
    The template is compiled when the query is planned.
    """
    nothing = F.array().cast("array<string>")

    def problems(node: dict[str, Any], keys: tuple[str, ...]) -> Column:
        """Problems of one object that is known to be there."""
        here, prefix = "$" + "".join(f"['{k}']" for k in keys), ".".join(keys) + "." if keys else ""
        found = []
        for key, want in node.items():
            path, label, slot = f"{here}['{key}']", prefix + key, _slot(want)
            kind = _kind(doc, path)
            if slot is None:
                wrong = F.when(~F.coalesce(_equals(doc, path, kind, want), F.lit(False)), F.array(F.lit(f"{label}: expected {want!r}")))
            else:
                wrong = F.when(~kind.rlike(slot[0]), F.array(F.lit(f"{label}: {slot[1]}")))
            if isinstance(want, dict):
                wrong = F.coalesce(wrong, problems(want, (*keys, key)))
            found.append(F.when(kind.isNull(), F.array(F.lit(f"{label}: missing"))).otherwise(F.coalesce(wrong, nothing)))
        own = F.json_object_keys(F.get_json_object(doc, here) if keys else doc)
        unknown = F.filter(F.coalesce(own, nothing), lambda k: ~k.isin(*node) if node else F.lit(True))
        return F.concat(*found, F.transform(unknown, lambda k: F.concat(F.lit(prefix), k, F.lit(": unexpected"))))

    return F.when(doc.isNull(), F.array(F.lit("root: expected object"))).otherwise(problems(template, ()))


def short_problems(problems: Column) -> Column:
    """One line for a retry prompt; paths lose what stands before their first dot."""
    return F.array_join(F.transform(problems, lambda p: F.regexp_replace(p, r"^[^.]*\.", "")), "; ")


#: JSON schema types of template values, by their Python types; null takes anything.
_SCHEMA_TYPES = {str: "string", bool: "boolean", int: "number", float: "number", list: "array", dict: "object"}


def json_schema(template: Any, enums: dict[str, list] | None = None) -> dict:
    """Closed JSON schema of a template; enumerations apply to its top keys."""
    schema = {"type": _SCHEMA_TYPES[type(template)]} if type(template) in _SCHEMA_TYPES else {}
    if schema.get("type") == "object":
        parts = {key: json_schema(value) | ({"enum": list(enums[key])} if enums and key in enums else {}) for key, value in template.items()}
        schema |= {"properties": parts, "required": [*parts], "additionalProperties": False}
    return schema


def response_format(name: str) -> dict:
    contract = CONTRACTS[name]
    return {"name": name, "strict": True, "schema": json_schema(contract["template"], contract.get("enums"))}


def render_contract(name: str) -> str:
    """Text of a contract for prompts: a head line and one JSON line per value of its first enumeration."""
    contract = CONTRACTS[name]
    rows = [contract["template"] | {key: value} for key, values in contract.get("enums", {}).items() for value in values] or [contract["template"]]
    return "\n".join([f"contract {name}", *(json.dumps(r, ensure_ascii=False) for r in rows)])


def branch(doc: Column, forced: Column | None = None) -> Column:
    """Branch a reply takes: bad_json, help, refused, publish, read_memo, write_memo, read_chatlog or read_page.

    Any other action reads a page; in the forced tail all but publishing is refused.
    """
    action = F.get_json_object(doc, "$.action")
    tail = F.lit(False) if forced is None else forced
    known = F.when(action.isin("help", "publish", "read_memo", "write_memo", "read_chatlog"), action).otherwise(F.lit("read_page"))
    return F.when(doc.isNull(), F.when(tail, F.lit("refused")).otherwise(F.lit("bad_json"))).when(tail & (known != "publish"), F.lit("refused")).otherwise(known)


def page_number(doc: Column) -> Column:
    """The page a reply names, if it is a whole JSON number; null for text, fractions and booleans."""
    return F.when(_kind(doc, "$.page") == "BIGINT", F.get_json_object(doc, "$.page").cast("bigint"))


def text_field(doc: Column, name: str) -> Column:
    """A field of the object if it is text; null for anything else."""
    return F.when(_kind(doc, f"$.{name}") == "STRING", F.get_json_object(doc, f"$.{name}"))


def join_parts(parts: Column) -> Column:
    """Content given as parts, joined without separators; null parts count as empty."""
    return F.array_join(F.transform(parts, lambda p: F.coalesce(p, F.lit(""))), "")
