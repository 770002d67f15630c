"""Secrets in texts: three fixed patterns, and literals that reach names of sensitive meaning.

The patterns (``assign``, ``access``, ``hex``) are searched in the whole text. Beside them, lines that look like
source or configuration are lexed: ``name = expression`` in its usual spellings (``=``, ``:``, ``:=``, ``=>``, quoted
keys, subscripts, typed names, keyword arguments, calls ``name("literal")`` and elements ``<name>text</name>``)
gives pairs of a target and the operands of its expression: literals, other names and ``${name}``. Constants are
propagated through the whole text, whatever the order of the lines: a value is put together from the literals its
names stand for, and the sensitivity of a target goes back to every literal that takes part in its value. A
literal's score is the sensitivity of a target it reaches times the quality of the value found there
(length, entropy, kinds of characters; none for placeholders). Literals that score ``threshold`` or more at some target
are added as spans of kind ``literal``, unless a pattern's span covers them already.

Defined cases: a null text is an empty one; it has no spans. Every row gives one row, repeated and null ids too.
Texts of any length are searched whole; a quote that is not closed on its line opens no literal, and no later one of its kind
on that line does. Names are flow-insensitive: all values of a name count. An empty table gives no rows. Other columns are
ignored. Nothing is shuffled, sent to tasks or collected. Places are code points, the end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwatch.llm.common import id_and_text

# The patterns, in the order in which spans with one start are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")

# How sensitive a name with these parts is. Of several, the most sensitive counts.
SENSITIVE = {
    ("password",): 1.0, ("passwd",): 1.0, ("passphrase",): 1.0, ("pwd",): 1.0, ("passcode",): 0.9, ("pass",): 0.8, ("pw",): 0.7,
    ("secret",): 1.0, ("credential",): 0.9, ("credentials",): 0.9, ("cred",): 0.8, ("token",): 0.9, ("bearer",): 0.9, ("jwt",): 0.9,
    ("apikey",): 1.0, ("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 0.9, ("auth", "key"): 0.9, ("signing", "key"): 0.9,
    ("encryption", "key"): 0.9, ("master", "key"): 0.9, ("shared", "key"): 0.9, ("account", "key"): 0.9, ("client", "key"): 0.8,
    ("license", "key"): 0.6, ("authorization",): 0.8, ("auth",): 0.6, ("connection", "string"): 0.6, ("dsn",): 0.5, ("salt",): 0.5,
    ("cookie",): 0.5, ("session", "key"): 0.7, ("key",): 0.3,
}
# Parts of names that hold something about a secret, not the secret.
ABOUT = {"field", "label", "placeholder", "name", "names", "url", "uri", "path", "file", "type", "id", "ids", "count", "length", "len", "max", "min",
         "regex", "pattern", "enabled", "required", "policy", "hint", "reset", "expiry", "expires", "ttl", "header", "prompt", "title", "error",
         "message", "format", "column", "index", "public", "endpoint", "size", "limit", "limits", "version"}
# Literals that stand for a value, and calls whose first argument names where it is read from.
_PLACEHOLDER = re.compile(r"""(?ix) ^(?: [*x.#?_-]+ | none | null | nil | true | false | undefined | changeme | todo | tbd | n/?a | string | str | password | secret | token )$
    | ^<.*>$ | ^\{\{.*\}\}$ | ^%\(.*\)s$ | example | your[_-] | placeholder | dummy | redacted | \.\.\.$ """)
_READERS = {"getenv", "get_env", "env", "environ", "get", "getproperty", "input", "getpass", "prompt", "lookup", "fetch", "read", "secretsmanager"}

#: Characters of a value that its quality is judged by; more of them would change nothing (40 bits are reached, or it is one character over and over).
VALUE_CHARS = 256

_LINE = re.compile(r"[=:]|</|\(\s*[\"'`]")
_TOKEN = re.compile(r"""
    (?P<space>[^\S\n]+)
  | (?P<triple>[bBrRuUfF]{0,2}(?:\"\"\"|'''))
  | (?P<quote>[bBrRuUfF]{0,2}["'`])
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z0-9_]+)*)
  | (?P<ref>\$\{[A-Za-z_][\w.-]*\}|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%)
  | (?P<op>:=|=>|==|!=|<=|>=|\|\||&&|->|::|//|[=:+.,;(){}\[\]<>\#&|?!\\\n-])
  | (?P<other>[0-9][\w.]*|.)""", re.X | re.A)
_REST = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*") for q in "\"'`"}
_BARE = re.compile(r"""[^\s"'`<>(){}\[\],;]+""")
_AFTER_BARE = re.compile(r"[^\S\n]*(?:[,;}\n]|#|//|$)")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)[^<>\n]*>([^<>\n]+)</\1>")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][\w.-]*)\}|\$([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\}")
_NAME = re.compile(r"[A-Za-z_][\w.-]*", re.A)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and not overlapping within a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more starts where the whole run of such characters starts
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


@dataclass
class Token:
    kind: str
    start: int
    end: int
    text: str  # of a string: what is between the quotes
    inner: int = 0  # of a string: where that begins


@dataclass
class Pair:
    """A target and what its expression is made of: (start, end) of literals, and names."""

    target: str
    operands: list[tuple[int, int] | str] = field(default_factory=list)


def _lex(text: str, start: int, end: int) -> tuple[list[Token], int]:
    """Tokens of the statement whose first line is ``start`` to ``end``, and where it ends: an
    open operator or bracket at a line's end goes on in the next line, and so does a triple-quoted string."""
    out, at, dead, line_end, depth = [], start, {}, end, 0
    while at < line_end:
        m = _TOKEN.match(text, at)
        kind, word = m.lastgroup, m.group()
        at = m.end()
        if kind == "triple":
            close = text.find(word[-3:], at)
            if close >= 0:
                out.append(Token("string", m.start(), close + 3, text[at:close], at))
                at = close + 3
                if at > line_end:
                    line_end = text.find("\n", at)
                    line_end = len(text) if line_end < 0 else line_end
        elif kind == "quote":
            mark = word[-1]
            inside = word == "'" and m.start() > start and text[m.start() - 1].isalnum()  # as in "don't"
            if not inside and dead.get(mark, -1) < at:
                stop = _REST[mark].match(text, at).end()
                if stop < len(text) and text[stop] == mark:
                    out.append(Token("string", m.start(), stop + 1, text[at:stop], at))
                    at = stop + 1
                else:
                    dead[mark] = line_end
        elif kind != "space" and word != "\n":
            out.append(Token(kind, m.start(), at, word))
            depth += (word in ("(", "[")) - (word in (")", "]"))
        goes_on = at >= line_end and line_end < len(text) and out and (
            out[-1].text in ("=", ":=", "+", "(", "\\") if out[-1].kind == "op" else out[-1].kind == "string" and depth > 0)
        if goes_on:
            if out[-1].text == "\\" and out[-1].kind == "op":
                out.pop()
            at = line_end + 1
            line_end = text.find("\n", at)
            line_end = len(text) if line_end < 0 else line_end
    return out, max(at, line_end)


def _targets(tokens: list[Token], at: int) -> list[str]:
    """Names that the assignment sign at place ``at`` gives a value to."""
    if not at:
        return []
    before = tokens[at - 1]
    if before.text == "]" and at >= 2:
        before = tokens[at - 2]
    if before.kind == "string":
        return [before.text] if _NAME.fullmatch(before.text) else []
    if before.kind != "name":
        return []
    names = [before.text]
    if at >= 3 and tokens[at - 2].text == ":" and tokens[at - 3].kind == "name":
        names = [tokens[at - 3].text]  # the name before is its type
    return names


def _operands(text: str, tokens: list[Token], at: int) -> list[tuple[int, int] | str]:
    """What the expression from place ``at`` on is made of."""
    out: list[tuple[int, int] | str] = []
    if at >= len(tokens):
        return out
    first = tokens[at]
    if first.kind != "string":
        bare = _BARE.match(text, first.start)
        if bare and _AFTER_BARE.match(text, bare.end()):
            out.append((first.start, bare.end()))
            if first.kind == "name" and first.end == bare.end():
                out.append(first.text)
            refs = [next(filter(None, m.groups())) for m in _REFERENCE.finditer(bare.group())]
            return refs or out
    depth, skip = 0, -1
    while at < len(tokens):
        token = tokens[at]
        if token.kind == "string":
            if at != skip:
                out.append((token.inner, token.inner + len(token.text)))
                if token.text.find("{") >= 0 or token.text.find("$") >= 0:
                    out.extend(next(filter(None, m.groups())) for m in _REFERENCE.finditer(token.text))
        elif token.kind in ("name", "ref"):
            called = at + 1 < len(tokens) and tokens[at + 1].text in ("(", "[")
            if called and token.text.lower().replace("-", ".").split(".")[-1] in _READERS:
                skip = at + 2
            elif not called:
                out.append(token.text.strip("${}%"))
        elif token.text in ("(", "["):
            depth += 1
        elif token.text in (")", "]"):
            depth -= 1
            if depth < 0:
                break
        elif token.text in ("+", ".", "||", "&", "\\") or (token.text == "," and depth > 0):
            pass
        else:
            break
        following = tokens[at + 1] if at + 1 < len(tokens) else None
        if depth == 0 and following and token.text not in ("+", ".", "||", "&", "\\") and not (
                following.kind == "string" and token.kind == "string" or following.text in ("+", ".", "||", "&", "(", "[", "\\")):
            break
        at += 1
    return out


def pairs(text: str) -> list[Pair]:
    """The assignments of a text."""
    out, at = [], 0
    while m := _LINE.search(text, at):
        start = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", m.start())
        tokens, at = _lex(text, start, len(text) if end < 0 else end)
        for k, token in enumerate(tokens):
            if token.kind != "op":
                continue
            if token.text in ("=", ":", ":=", "=>"):
                typed = token.text == ":" and k + 2 < len(tokens) and tokens[k + 1].kind == "name" and tokens[k + 2].text == "="
                path = token.text == ":" and k + 1 < len(tokens) and tokens[k + 1].text == "//"
                names = [] if typed or path else _targets(tokens, k)
                operands = _operands(text, tokens, k + 1) if names else []
                out.extend(Pair(name, operands) for name in names if operands)
            elif token.text == "(" and 0 < k < len(tokens) - 2 and tokens[k - 1].kind == "name" and tokens[k + 1].kind == "string" and tokens[k + 2].text == ")":
                if tokens[k - 1].text.lower().split(".")[-1] not in _READERS:
                    out.append(Pair(tokens[k - 1].text, [(tokens[k + 1].inner, tokens[k + 1].inner + len(tokens[k + 1].text))]))
        if text.find("</", start, at) >= 0:
            out.extend(Pair(e.group(1), [e.span(2)]) for e in _ELEMENT.finditer(text, start, at))
        at += 1
    return out


def sensitivity(name: str) -> float:
    """How surely a name says that its value is secret, 0 to 1."""
    parts = tuple(p.lower() for p in _PARTS.findall(name.replace(".", "_").replace("-", "_")))
    best = max((SENSITIVE.get(parts[i:i + n], 0.0) for n in (1, 2) for i in range(len(parts) - n + 1)), default=0.0)
    return best * 0.2 if best and not ABOUT.isdisjoint(parts) else best


def quality(value: str) -> float:
    """How much a value looks like a secret, 0 to 1."""
    if len(value) < 6 or _PLACEHOLDER.search(value):
        return 0.0
    counts = Counter(value)
    bits = -sum(n * math.log2(n / len(value)) for n in counts.values())
    kinds = (any("a" <= c <= "z" for c in counts) + any("A" <= c <= "Z" for c in counts) + any("0" <= c <= "9" for c in counts)
             + any(not c.isalnum() and not c.isspace() for c in counts))
    words = 0.3 if len(value.replace("\n", "").split()) > 1 else 1.0  # prose rather than a key
    return min(1.0, bits / 40) * min(1.0, 0.55 + 0.15 * kinds) * words


def _last(name: str) -> str:
    """Of ``object.attribute``, the attribute names the value."""
    return name.split(".")[-1]


class Constants:
    """Names of a text with what they are given, and the values put together from it."""

    def __init__(self, text: str, found: list[Pair]) -> None:
        self.text, self.values = text, {}
        self.defined: dict[str, list[Pair]] = defaultdict(list)
        for pair in found:
            self.defined[_last(pair.target)].append(pair)

    def names(self, pair: Pair) -> list[str]:
        return [_last(o) for o in pair.operands if isinstance(o, str) and _last(o) in self.defined]

    def _joined(self, pair: Pair) -> str:
        """Literals and values in a row; a bare word that is a known name stands for its value alone,
        and a name without a value yet (a cycle) for none."""
        named, out, size = set(self.names(pair)), [], 0
        for o in pair.operands:
            part = self.values.get(_last(o), "") if isinstance(o, str) else self.text[o[0]:min(o[1], o[0] + VALUE_CHARS)]
            if isinstance(o, str) or part not in named:
                out.append(part)
                size += len(part)
            if size >= VALUE_CHARS:
                break
        return "".join(out)[:VALUE_CHARS]

    def value(self, pair: Pair) -> str:
        """What the expression amounts to; of a name assigned to more than once, the last counts."""
        todo, open_ = [(n, False) for n in self.names(pair)], set()
        while todo:  # depth first: a name's value after those it needs
            name, ready = todo.pop()
            if ready:
                self.values[name] = self._joined(self.defined[name][-1])
            elif name not in self.values and name not in open_:
                open_.add(name)
                todo.append((name, True))
                todo.extend((n, False) for n in self.names(self.defined[name][-1]))
        return self._joined(pair)


def literal_spans(text: str, threshold: float = 0.4) -> list[tuple[int, int]]:
    """(start, end) of the literals that reach a sensitive name with a value of that score."""
    found = pairs(text)
    if not found:
        return []
    constants = Constants(text, found)
    reached = [pair for pair in found if (weight := sensitivity(pair.target)) >= threshold and weight * quality(constants.value(pair)) >= threshold]
    literals: set[tuple[int, int]] = set()
    opened: set[str] = set()
    while reached:  # back to every literal that takes part
        for operand in reached.pop().operands:
            if isinstance(operand, tuple):
                literals.add(operand)
            elif _last(operand) not in opened:
                opened.add(_last(operand))
                reached.extend(constants.defined.get(_last(operand), ()))
    return sorted(s for s in literals if s[1] > s[0] and _last(text[s[0]:s[1]]) not in constants.defined)


def all_spans(text: str | None, threshold: float = 0.4) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, by start, then kind as listed."""
    if not text:
        return []
    out = base_spans(text)
    covered = [(s, e) for s, _, e in out]
    for start, end in literal_spans(text, threshold):
        if not any(s <= start and end <= e for s, e in covered):
            out.append((start, "literal", end))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def scan(docs: DataFrame, threshold: float = 0.4) -> DataFrame:
    """One row per row: doc_id and ``spans``, an array of (kind, start, stop) by start, then kind."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [all_spans(t, threshold) for t in batch["text"].to_pylist()]
            flat = [s for spans in each for s in spans]
            structs = pa.StructArray.from_arrays(
                [pa.array([k for _, k, _ in flat], pa.string()), pa.array([s for s, _, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())],
                names=["kind", "start", "stop"])
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in each])], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, structs)], names=["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(found, "doc_id long, spans array<struct<kind:string,start:int,stop:int>>")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
