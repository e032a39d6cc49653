"""Nested JSON without recursion: one pass over a text's signs, strings and plain values.

What the library's reader can read it reads, deep text part by part; other text is read with a list of the containers
that are open. Each object is known by its place in the text. Malformed text gives nothing; it never fails a run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocabulary as V
from ..functions.text import female_only_value

_TOKEN = re.compile(
    r"[ \t\n\r]*(?:([{}\[\],:])"
    r'|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity))"
)
_PLAIN = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_DIGITS = 4_000  # longer integers are read as floating-point numbers
VALUE, ITEM, KEY, FIRST_KEY, COLON, NEXT = range(6)
_BLANK = re.compile(r"[ \t\n\r]*")
_BRACE = re.compile(r'(?:[^"{}]++|"[^"\\]*+(?:\\.[^"\\]*+)*+")*+([{}])', re.DOTALL)
_HALF, _PAIR = r"\\u[dD][89a-fA-F]", r"\\u[dD][89abAB]..\\u[dD][c-fC-F]"
LAYER = 300  # containers in one another that the library reads at once


def whole_characters(text: str) -> str:
    """Halves of character pairs that stand alone become replacement characters."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _string(token: str) -> str:
    return whole_characters(json.loads(token)) if "\\" in token else token[1:-1]


def _plain(token: str) -> object:
    if token in _PLAIN:
        return _PLAIN[token]
    return int(token) if token.lstrip("-").isdigit() and len(token) < _DIGITS else float(token)


def _integer(token: str) -> int | float:
    return int(token) if len(token) < _DIGITS else float(token)


class _Repeated(Exception):
    """A name stands twice in an object."""


def _members(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Repeated
    return out


_scan = json.JSONDecoder(object_pairs_hook=_members, parse_int=_integer).scan_once


def _halves(text: str) -> bool:
    """Whether a string may hold half of a character pair."""
    if not re.search(_HALF, text):
        return False
    return "\\\\" in text or re.search(_HALF, re.sub(_PAIR, "", text)) is not None


def _scan_deep(text: str) -> tuple[object, int, int]:
    """The value that a text starts with, where it ends and how many members it names, read from its innermost parts outwards.

    A part of ``LAYER`` containers in one another stands in the part around it as a number that the text doesn't have.
    """
    bare = re.sub(r"\\.", "__", text, flags=re.DOTALL) if "\\" in text else text
    codes = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.cumsum(codes == ord('"')) % 2 == 0
    opens = plain & ((codes == ord("{")) | (codes == ord("[")))
    closes = plain & ((codes == ord("}")) | (codes == ord("]")))
    depth = np.cumsum(opens.astype(np.int32) - closes)
    ended = np.flatnonzero(depth == 0)
    if not len(ended):
        raise ValueError("never closed")
    end = int(ended[0]) + 1
    opens, closes, depth = opens[:end], closes[:end], depth[:end]
    members = int(np.count_nonzero(plain[:end] & (codes[:end] == ord(":"))))
    mark = next(m for m in (f"0.{i}1e" for i in count()) if m not in text)
    found: list[object] = []

    def told(token: str) -> object:
        return found[int(token[len(mark) :])] if token.startswith(mark) else float(token)

    scan = json.JSONDecoder(parse_int=_integer, parse_float=told).scan_once
    inner: list[tuple[int, int, int]] = []  # where a part begins and ends, and its number
    first, last = np.flatnonzero(opens & (depth % LAYER == 1 % LAYER)), np.flatnonzero(closes & (depth % LAYER == 0))
    begun, closed = depth[first] // LAYER, depth[last] // LAYER
    for level in range(int(begun.max()), -1, -1):
        parts, at = [], 0
        for low, high in zip(first[begun == level].tolist(), (last[closed == level] + 1).tolist(), strict=True):
            pieces, place = [], low
            while at < len(inner) and inner[at][0] < high:
                start, stop, number = inner[at]
                pieces.append(f"{text[place:start]} {mark}{number} ")
                place, at = stop, at + 1
            part = "".join([*pieces, text[place:high]])
            value, stop = scan(part, 0)
            if stop != len(part):
                raise ValueError("closed too early")
            parts.append((low, high, len(found)))
            found.append(value)
        inner = parts
    return found[-1], end, members


class Reading:
    """One JSON value: its Python form, where it ends, and its objects in the order they open."""

    def __init__(self, text: str, at: int = 0):
        self.source = text
        self.root: object = None
        self.objects: list[tuple[dict, int]] = []  # with the index of their span
        self.repeated: list[tuple[int, int]] = []  # members that a later one of the same name replaces
        self._spans: list[list[int]] | None = None
        self._start = _BLANK.match(text, at).end()
        self.end = self._read_at_once()
        if self.end is None:
            self._spans = []
            self.end = self._read(at)

    def _read_at_once(self) -> int | None:
        """Where the value ends by the library's reader; -1 if the text is malformed, None if it must be read sign by sign."""
        text, at, members = self.source, self._start, None
        try:
            try:
                root, end = _scan(text, at)
            except RecursionError:
                root, end, members = _scan_deep(text[at:])
                end += at
        except (ValueError, StopIteration):
            return -1
        except (RecursionError, _Repeated):
            return None
        if _halves(text[at:end]):
            return None
        todo, found = [root] if isinstance(root, dict | list) else [], []
        while todo:
            item = todo.pop()
            if type(item) is dict:
                found.append(item)
                item = item.values()
            for value in reversed(item):
                if type(value) is dict or type(value) is list:
                    todo.append(value)
        if members is not None and members != sum(map(len, found)):  # a name stands twice
            return None
        self.root, self.objects = root, list(zip(found, range(len(found)), strict=True))
        return end

    @property
    def spans(self) -> list[list[int]]:
        """Of each object: start, end, index of the object around it."""
        if self._spans is None:
            self._spans, open_, at = [], [], self._start
            while at < self.end and (found := _BRACE.match(self.source, at, self.end)):
                at = found.end()
                if found[1] == "{":
                    self._spans.append([at - 1, -1, open_[-1] if open_ else -1])
                    open_.append(len(self._spans) - 1)
                else:
                    self._spans[open_.pop()][1] = at
        return self._spans

    def _read(self, at: int) -> int:
        """Where the value ends; -1 if the text is malformed."""
        match, text = _TOKEN.match, self.source
        stack: list[tuple[object, int, list]] = []  # open containers, the object they are or stand in, names and places of members
        expect, key, inside = VALUE, "", -1
        while True:
            found = match(text, at)
            if found is None:
                return -1
            sign, string, plain = found.groups()
            at = found.end()
            if expect == COLON:
                if sign != ":":
                    return -1
                expect = VALUE
                continue
            if expect in (KEY, FIRST_KEY) and string is not None:
                key, expect = _string(string), COLON
                stack[-1][2].append((key, found.start(2)))
                continue
            closes = sign == "}" and expect in (FIRST_KEY, NEXT) or sign == "]" and expect in (ITEM, NEXT)
            if closes and stack and isinstance(stack[-1][0], dict) == (sign == "}"):
                done, index, members = stack.pop()
                if sign == "}":
                    self.spans[index][1] = at
                    if len(members) > len(done):
                        last = {name: i for i, (name, _) in enumerate(members)}
                        self.repeated += [
                            (start, members[i + 1][1]) for i, (name, start) in enumerate(members) if last[name] != i
                        ]
                inside = stack[-1][1] if stack else -1
                if not stack:
                    self.root = done
                    return at
                expect = NEXT
                continue
            if expect == NEXT:
                if sign != ",":
                    return -1
                expect = KEY if isinstance(stack[-1][0], dict) else VALUE
                continue
            if expect not in (VALUE, ITEM) or sign not in (None, "{", "["):
                return -1
            value = {} if sign == "{" else [] if sign == "[" else _string(string) if string is not None else _plain(plain)
            if stack:
                holder = stack[-1][0]
                if isinstance(holder, dict):
                    holder[key] = value
                else:
                    holder.append(value)
            if sign == "{":
                self.objects.append((value, len(self.spans)))
                self.spans.append([found.start(1), -1, inside])
                inside = len(self.spans) - 1
                stack.append((value, inside, []))
                expect = FIRST_KEY
            elif sign == "[":
                stack.append((value, inside, []))
                expect = ITEM
            elif stack:
                expect = NEXT
            else:
                self.root = value
                return at

    def text(self, index: int) -> str:
        """An object's own text, without members that others replace."""
        start, end, _ = self.spans[index]
        if not self.repeated:
            return self.source[start:end]
        out = []
        for low, high in sorted(x for x in self.repeated if start < x[0] and x[1] <= end):
            if low >= start:
                out.append(self.source[start:low])
                start = high
        return "".join([*out, self.source[start:end]])


def read(text: str | None) -> Reading | None:
    """The one value that a text is; None if it isn't one."""
    if not text:
        return None
    found = Reading(text)
    return found if found.end >= 0 and not text[found.end :].strip(" \t\n\r") else None


def read_from(text: str, at: int) -> Reading | None:
    """The value that starts at a place of a text, whatever follows it."""
    found = Reading(text, at)
    return found if found.end >= 0 else None


@lru_cache(10_000)
def _finds_short(key: re.Pattern, name: str) -> bool:
    return bool(key.search(name))


def _finds(key: re.Pattern, name: str) -> bool:
    return _finds_short(key, name) if len(name) <= 64 else bool(key.search(name))


def texts_under(value: object, key: re.Pattern) -> Iterator[str]:
    """Every non-blank string and every number below a member whose name the pattern finds."""
    todo = [(value, False)]
    while todo:
        item, under = todo.pop()
        if isinstance(item, dict):
            for name, child in reversed(item.items()):
                if (told := under or _finds(key, name)) or type(child) is dict or type(child) is list:
                    todo.append((child, told))
        elif isinstance(item, list):
            todo.extend((child, under) for child in reversed(item))
        elif under and item is not None:
            text = item.strip() if isinstance(item, str) else str(item)
            if text:
                yield text


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("pos", "parent", "start", "length")])


@F.pandas_udf(T.ArrayType(_SPAN))
def object_spans(texts: pd.Series) -> pd.Series:
    """The objects of JSON texts, outer before inner: where each stands (from 1), and in which one."""

    def spans(text: str | None) -> list[dict]:
        found = read(text)
        return [
            {"pos": i, "parent": around if around >= 0 else None, "start": start + 1, "length": end - start}
            for i, (start, end, around) in enumerate(found.spans if found else ())
        ]

    return texts.map(spans)


def walk_objects(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per nested object of a JSON column: ``<key>, pos, parent, start, length, object``.

    What the reading returns is linear in the text, whatever its depth: places. ``object``, the object's text, is cut
    out by Spark, and only if it is used; it is read further with variant functions. Malformed text yields no rows.
    """
    spans = df.select(F.col(key), F.col(text).alias("_text"), F.inline(object_spans(F.col(text))))
    return spans.select(key, "pos", "parent", "start", "length", F.substr("_text", F.col("start"), F.col("length")).alias("object"))


# --- stored payloads, on the JVM -----------------------------------------------------

# Quantifiers that never give back, so that long strings and many escapes need no stack.
_SIGNS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++'


def _unquoted(token: Column) -> Column:
    plain = F.substr(token, F.lit(2), F.length(token) - 2)
    return F.when(~F.contains(token, F.lit("\\")), plain).otherwise(F.try_variant_get(F.try_parse_json(token), "$", "string"))


def names_women_only(raw: Column) -> Column:
    """Whether any value under a gender-like key of a JSON text, at any depth, restricts to women.

    One fold over the text's tokens: how deep it is, the depth of the gender-like member it is in (-1: none), and
    the last string, which is a name if a colon follows and else a value. Texts that Spark's parser refuses count as
    empty; only those that may name such a key are read.
    """
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(-1).alias("inside"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("found")
    )

    def step(state: Column, token: Column) -> Column:
        depth, inside, last = state["depth"], state["inside"], state["last"]
        named = F.when((inside < 0) & _unquoted(last).rlike(V.GENDER_KEY_PATTERN), depth).otherwise(inside)
        left = ((token == ",") & (inside == depth)) | (token.isin("}", "]") & (inside >= depth))
        signs = token.isin("{", "}", "[", "]", ":", ",")
        value = F.when(last.isNotNull() & (token != ":"), _unquoted(last)).when(~signs & ~token.startswith('"') & (token != "null"), token)
        return F.struct(
            F.when(token.isin("{", "["), depth + 1).when(token.isin("}", "]"), depth - 1).otherwise(depth).alias("depth"),
            F.when(token == ":", named).when(left, F.lit(-1)).otherwise(inside).alias("inside"),
            F.when(token.startswith('"'), token).alias("last"),
            (state["found"] | F.when(inside >= 0, F.coalesce(female_only_value(value), F.lit(False))).otherwise(F.lit(False))).alias("found"),
        )

    may = raw.rlike(V.GENDER_KEY_PATTERN) | F.contains(raw, F.lit("\\u"))
    tokens = F.when(may & F.try_parse_json(raw).isNotNull(), F.regexp_extract_all(raw, F.lit(_SIGNS), F.lit(0)))
    return F.coalesce(F.aggregate(tokens, start, step, lambda s: s["found"]), F.lit(False))
