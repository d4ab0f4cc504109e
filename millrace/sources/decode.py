"""Request documents: strict JSON, and the core of YAML 1.2."""

from __future__ import annotations

import json
import re
from typing import Any

from ..plans.errors import refuse
from ..plans.grammar import LIMITS, depth

_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?")


def decode(source: str | bytes) -> Any:
    """A JSON tree from JSON, or from YAML where the text isn't JSON."""
    if isinstance(source, bytes):
        try:
            source = source.decode("utf-8")
        except UnicodeDecodeError:
            raise refuse("ENCODING_INVALID") from None
    if len(source.encode("utf-8", "surrogatepass")) > LIMITS["bytes"]:
        raise refuse("STRUCTURAL_LIMIT_EXCEEDED", "", [f"Use at most {LIMITS['bytes']} UTF-8 bytes."])
    body = source.strip()
    if m := re.fullmatch(r"```(?:json|ya?ml)?[ \t]*\n(.*?)\n?```", body, re.S):
        body = m[1]
    tree = read_json(body) if body[:1] in ("{", "[") else read_yaml(body)
    if depth(tree) > LIMITS["depth"]:
        raise refuse("STRUCTURAL_LIMIT_EXCEEDED", "", [f"Use at most {LIMITS['depth']} levels."])
    return tree


def read_json(source: str) -> Any:
    def pairs(items: list[tuple[str, Any]]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            raise refuse("ENCODING_DUPLICATE_KEY")
        return out

    def constant(_: str) -> Any:
        raise ValueError

    def number(x: str) -> Any:
        value = float(x)
        return int(value) if value == int(value) and abs(value) < 2**53 else value

    try:
        return json.loads(source, object_pairs_hook=pairs, parse_constant=constant, parse_float=number)
    except (ValueError, RecursionError):
        raise refuse("ENCODING_INVALID") from None


def _scalar(event: Any) -> Any:
    text = event.value
    if event.style is not None:  # quoted or block
        return text
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if _INT.fullmatch(text):
        return int(text, 8 if text.startswith("0o") else 16 if text.startswith("0x") else 10)
    if _FLOAT.fullmatch(text):
        value = float(text)
        return int(value) if value == int(value) and abs(value) < 2**53 else value
    return text


def read_yaml(source: str) -> Any:
    """From the parser's events alone, so that no anchor is expanded and no tag resolved."""
    import yaml

    stack: list[list] = []  # [container, pending key, has key]
    documents, result = 0, None

    def put(value: Any) -> None:
        nonlocal result
        if not stack:
            result = value
            return
        top = stack[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        elif not top[2]:
            if value == "<<":
                raise refuse("ENCODING_MERGE_KEY_FORBIDDEN")
            if not isinstance(value, (str, int, bool, type(None))) or isinstance(value, (dict, list)):
                raise refuse("ENCODING_INVALID")
            key = value if isinstance(value, str) else json.dumps(value)
            if key in top[0]:
                raise refuse("ENCODING_DUPLICATE_KEY")
            top[1], top[2] = key, True
        else:
            top[0][top[1]], top[2] = value, False

    try:
        for e in yaml.parse(source, Loader=yaml.SafeLoader):
            if isinstance(e, yaml.AliasEvent) or getattr(e, "anchor", None):
                raise refuse("ENCODING_ANCHOR_FORBIDDEN")
            if isinstance(e, yaml.DocumentStartEvent):
                documents += 1
                if documents > 1:
                    raise refuse("ENCODING_MULTIDOC_FORBIDDEN")
            elif isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent, yaml.ScalarEvent)):
                if e.tag is not None and not (isinstance(e, yaml.ScalarEvent) and e.tag == "!"):
                    raise refuse("ENCODING_TAG_FORBIDDEN")
                if isinstance(e, yaml.ScalarEvent):
                    put(_scalar(e))
                else:
                    stack.append([{} if isinstance(e, yaml.MappingStartEvent) else [], None, False])
            elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
                put(stack.pop()[0])
    except yaml.YAMLError:
        raise refuse("ENCODING_INVALID") from None
    return result
