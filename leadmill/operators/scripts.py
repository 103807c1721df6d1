"""Values that pages carry in their scripts: state assigned to variables, passed to functions, or as JSON of its own."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leadmill.operators.windows import spread

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_JSON_TYPE = re.compile(r"type\s*=\s*[\"']?application/(?:[\w.-]+\+)?json", re.I)
_LINKED = re.compile(r"ld\+json", re.I)
_TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{))*`)|(?P<number>-?(?:0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))|(?P<name>[A-Za-z_$][\w$]*)|(?P<mark>![01]|[{}\[\]:,])|(?P<other>.)""", re.S)
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
_WORDS = {"true": "true", "false": "false", "null": "null", "undefined": "null", "NaN": "null", "Infinity": "null"}


def _paired(raw: str) -> str:
    """Halves of a pair become one."""
    return raw.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _said(literal: str) -> str:
    """The text of a string literal."""
    raw = _ESCAPE.sub(lambda m: chr(min(int(m[1] or m[2] or m[3], 16), 0x10FFFF)) if m[4] is None else _PLAIN.get(m[4], m[4]), literal[1:-1])
    return _paired(raw)


_JSON = json.JSONDecoder(parse_constant=lambda _: None, parse_int=float)
_SPACE = re.compile(r"[ \t\n\r]*")


def _loaded_flat(text: str):
    """The value of a JSON text, without recursion."""
    after = lambda at: _SPACE.match(text, at).end()

    def key_at(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("no key")
        key, at = _JSON.raw_decode(text, at)
        if text[(at := after(at)) : at + 1] != ":":
            raise ValueError("no value")
        return key, after(at + 1)

    at, open_ = after(0), []
    while True:
        mark = text[at : at + 1]
        if mark and mark in "{[":
            box, key, at = {} if mark == "{" else [], None, after(at + 1)
            if text[at : at + 1] != ("}" if mark == "{" else "]"):
                if mark == "{":
                    key, at = key_at(at)
                open_.append((box, key))
                continue
            value, at = box, at + 1
        else:
            value, at = _JSON.raw_decode(text, at)
        while open_:
            box, key = open_[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = after(at)
            mark = text[at : at + 1]
            if mark == ",":
                at = after(at + 1)
                if isinstance(box, dict):
                    key, at = key_at(at)
                    open_[-1] = box, key
                break
            if mark != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not closed")
            value, at = box, at + 1
            open_.pop()
        else:
            if after(at) != len(text):
                raise ValueError("more than one value")
            return value


def loaded(text: str):
    """The value of a JSON text of any depth; ValueError where it is none. Of keys that an object repeats the last counts,
    numbers are floats."""
    try:
        return _JSON.decode(text)
    except RecursionError:
        return _loaded_flat(text)


def _inner(value: dict | list, items: int | None) -> Iterator[tuple[int, str | None, object]]:
    if isinstance(value, dict):
        yield from ((i, k, value[k]) for i, k in enumerate(sorted(value)))
    else:
        yield from ((i, None, x) for i, x in enumerate(value[:items]))


def containers(value, depth: int | None = None, items: int | None = None) -> Iterator[tuple[list[int], str | None, dict | list]]:
    """(path, key, value) of the objects and lists in a value, outer ones first, keys in the order of their names; key: None
    for items of a list. The path is one list that goes along. depth: levels below the first; items: of a list so many."""
    path: list[int] = []
    todo = [iter([(None, None, value)])]
    while todo:
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
            if path:
                path.pop()
            continue
        at, key, x = step
        if not isinstance(x, (dict, list)):
            continue
        if at is not None:
            path.append(at)
        yield path, key, x
        # one that isn't looked into has no way back of its own
        todo.append(_inner(x, items) if depth is None or len(path) < depth else iter(()))


def literal_at(code: str, at: int) -> tuple[str, int] | None:
    """The object or list literal that begins there, as JSON, and where it ends; None where it is code or never closes."""
    out, open_ = [], []
    key = False  # a name may stand for a key
    for m in _TOKEN.finditer(code, at):
        kind, token = m.lastgroup, m[0]
        if kind == "skip":
            continue
        if kind == "mark" and token in "{[":
            open_.append(token)
            out.append(token)
            key = token == "{"
        elif kind == "mark" and token in "}]":
            if not open_ or (open_.pop() == "{") != (token == "}"):
                return None
            if out[-1] == ",":
                out.pop()  # a comma at the end
            out.append(token)
            key = False
            if not open_:
                text = "".join(out)
                try:
                    loaded(text)
                except ValueError:
                    return None
                return text, m.end()
        elif kind == "mark":
            out.append({"!0": "true", "!1": "false"}.get(token, token))
            key = token == "," and open_[-1:] == ["{"]
        elif kind == "string":
            out.append(json.dumps(_said(token), ensure_ascii=False))
            key = False
        elif kind == "number":
            out.append(json.dumps(token) if key else str(int(token, 16)) if token[:3].lower().lstrip("-").startswith("0x") else json.dumps(float(token)) if not re.fullmatch(r"-?(?:0|[1-9]\d*)", token) else token)
            key = False
        elif kind == "name" and (key or token in _WORDS):
            out.append(json.dumps(token) if key else _WORDS[token])
            key = False
        else:
            return None
    return None


_BEFORE = re.compile(r"([\w$.\]\"']*)\s*=\s*$")
_START = re.compile(r"[{\[]|JSON\.parse\s*\(\s*(?=[\"'`])")


def values_of(code: str) -> Iterator[tuple[str, str]]:
    """(name, JSON) of the literals in a script, in order: what is assigned, passed or parsed. A literal within another is
    part of it."""
    at = 0
    while m := _START.search(code, at):
        at = m.end()
        if m[0][0] == "J":
            token = _TOKEN.match(code, at)
            if token and token.lastgroup == "string":
                at = token.end()
                text = _said(token[0])
                try:
                    loaded(text)
                except ValueError:
                    continue
                yield "JSON.parse", text
            continue
        head = code[max(0, m.start() - 200) : m.start()].rstrip()
        if head and head[-1] not in "=(,:[":  # a block of code, an index
            continue
        if found := literal_at(code, m.start()):
            text, at = found
            name = _BEFORE.search(head)
            yield (name[1] if name else ""), text


def page_values(html: str | None) -> Iterator[tuple[int, int, str, str]]:
    """(script, no, name, JSON) of the literals in all scripts of a page, but for JSON-LD."""
    for script, m in enumerate(_SCRIPT.finditer(html or "")):
        if _LINKED.search(m[1]):
            continue
        found = list(values_of(m[2]))
        if _JSON_TYPE.search(m[1]):
            try:
                loaded(m[2])
                found = [("", m[2].strip())]
            except ValueError:
                pass
        yield from ((script, no, name, text) for no, (name, text) in enumerate(found))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(page_id, *found) for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for found in page_values(html)]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], ["page_id", "script", "no", "name", "json"])


def script_values(pages: DataFrame) -> DataFrame:
    """(page_id, script, no, name, json): object and list literals of all scripts of pages(page_id, html), but for JSON-LD.
    Keys without quotes, quotes of any kind, escapes, comments and commas at the end are read; code isn't run."""
    return spread(pages.select("page_id", "html"), "page_id").mapInArrow(_scan, "page_id long, script int, no int, name string, json string")


_NAMES = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string())


def named_texts(pages: DataFrame, keys: list[str], objects: list[str], depth: int | None = None, items: int | None = None) -> DataFrame:
    """(page_id, raw, script, no, path, at): texts, trimmed, not empty, under one of the keys in the objects of script
    values, and under `name` of an object that is under one of objects (in lower case). One pass over a page, whatever the
    depth of its values."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NAMES, strict=True)], ["page_id", "raw", "script", "no", "path", "at"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for script, no, _, text in page_values(html):
                    for path, key, x in containers(loaded(text), depth, items):
                        if not isinstance(x, dict):
                            continue
                        for at in [*keys, "name"] if key is not None and key.lower() in objects else keys:
                            raw = x.get(at)
                            if isinstance(raw, str) and (raw := _paired(raw).strip(" ")):
                                rows.append((page_id, raw, script, no, list(path), at))
                                size += 100 + len(raw) + 4 * len(path)
                        if size > 8_000_000:
                            yield batch_of(rows)
                            rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return spread(pages.select("page_id", "html"), "page_id").mapInArrow(scan, "page_id long, raw string, script int, no int, path array<int>, at string")
