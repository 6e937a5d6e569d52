"""Secrets in text: three base patterns, and assignments lexed into names and literals.

The lexer visits every ``:`` and ``=`` of a text. Left of it stands a target name (``password``,
``cfg.db_password``, ``"api-key"``, ``env['TOKEN']``), also with its type (``token: str =``,
``var token string =``), which is neither a target nor a value; right of it an expression: quoted literals, names and
bare values, joined by ``+`` or standing side by side. A name assigned a literal is a constant from there
on; where a later assignment uses it, its value is put in place. A literal counts as a secret when the
weight of the sensitive words in its target name and the look of its value reach a threshold. Its span is
that of the literals, wherever the constant was written. Spans inside a base span are not added.
"""

from __future__ import annotations

import math
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of the runs [0-9a-f]+ those long enough
KINDS = ("assign", "access", "hex", "literal")
#: Each match of ASSIGN holds one of these.
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Weights of words in target names, and values that stand for no secret.
NAME_WEIGHT = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "apikey": 3, "token": 3,
    "credential": 3, "credentials": 3, "private": 2, "auth": 2, "bearer": 2, "access": 1, "key": 1, "pass": 2,
}
#: These stand for no secret as whole words of a value, the ones of ``PLACEHOLDERS`` also inside a word.
PLACEHOLDER_WORDS = ("none", "null", "true", "false", "todo", "test")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx")
LEAST = 5

_MARK = re.compile(r"[:=]")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.\-]*")
_TERM = re.compile(
    r"""(?:[bBrRuU]{0,2})"((?:[^"\\\n]|\\.)*)"|(?:[bBrRuU]{0,2})'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9+/_.=$@~!%^*\-]+)"""
)
_GAP = re.compile(r"[\x20\t]*")


def _bracketed(depth: int) -> str:
    plain = r"[-=]>|[^\[\]<>(){}]"
    inner = f"(?:{plain}|{_bracketed(depth - 1)})*+" if depth else f"(?:{plain})*+"
    return rf"(?:\[{inner}\]|<{inner}>|\({inner}\)|\{{{inner}\}})"


_GROUP = _bracketed(3)
_UNIT = (
    r"(?:[&*?!]|'[a-z_]\w*+[\x20\t]+|\[\w*\](?=[\w*\[])|(?:mut|dyn|impl|const|constant|static|readonly|unique|keyof|typeof|unsigned)[\x20\t]+)*+"
    rf"(?:[A-Za-z_$][\w$]*+(?:(?:\.|::)[A-Za-z_$][\w$]*+)*+|{_GROUP})(?:{_GROUP}|[?!*&])*+"
)
_JOINED = rf"{_UNIT}(?:[\x20\t]*+(?:[|&]|[-=]>)[\x20\t]*+{_UNIT})*+"
#: What follows the colon of a typed target up to its ``=``: space before it, or a literal after it, tells it from a value with ``=``.
_TYPE = re.compile(
    rf"""[\x20\t]*+(?:{_JOINED}|(?P<quoted>"{_JOINED}"|'{_JOINED}'))(?:(?P<space>[\x20\t]+)|(?=:?=[\x20\t]*[bBrRuU]{{0,2}}["']))(?=:?=(?![=>]))""", re.A
)
#: A declaration with the name before the type, up to its ``=``.
_NAME_TYPE = re.compile(
    rf"(?:(?<![\w$.])(?P<key>var|const|declare)[\x20\t]+)?(?<![\w$.@])@?(?P<name>[A-Za-z_$][\w$]*+)[\x20\t]+(?P<type>(?:\*|\[\w*\]|map\[[\w.]*\])*+[A-Za-z_][\w.]*+(?:{_GROUP})?)[\x20\t]*\Z",
    re.I | re.A,
)
# Words that stand before a name, and types that stand before or behind one.
_KEYWORDS = {"var", "const", "let", "val", "static", "final", "export", "declare", "public", "private", "protected", "return", "set", "local", "type", "and", "or", "with", "def", "my", "our", "readonly"}
_TYPES_FIRST = {"char", "string", "str", "auto", "wchar_t", "int", "long", "object", "unsigned", "byte", "bool", "dynamic", "qstring", "text", "charsequence"}
_TYPES_LAST = {"string", "byte", "rune", "error", "any", "varchar", "nvarchar", "char", "nchar", "text"}
_JOIN = re.compile(r"[\x20\t]*\+[\x20\t]*|[\x20\t]+(?=[\"'])")


def _target(text: str, at: int) -> str:
    """The name that ends before ``at``; empty without one."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    while end and text[end - 1] in "\"']":
        end -= 1
    start = end
    while start and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "_.-$")):
        start -= 1
    return text[start:end]


def _declared_from(text: str, at: int, low: int) -> list[int]:
    """Where ``name type`` that ends before ``at`` may start, with a word before it and without; one pass back, to ``low`` at most."""

    def back(i: int, chars: str) -> int:
        while i > low and (text[i - 1].isalnum() or text[i - 1] in chars):
            i -= 1
        return i

    def gap(i: int) -> int:
        while i > low and text[i - 1] in " \t":
            i -= 1
        return i

    i, depth = gap(at), 0
    while i > low and (depth or text[i - 1] in ")]}>"):
        i -= 1
        if text[i] in ")]}>" and not (text[i] == ">" and i > low and text[i - 1] in "-="):
            depth += 1
        elif text[i] in "([{<":
            depth -= 1
    name = back(gap(back(i, "_.*[]")), "_$")
    name -= name > low and text[name - 1] == "@"
    return [back(gap(name), "_$"), name]


def _name_before_type(text: str, at: int, low: int) -> str:
    """The name of ``var name type`` or ``name type`` between ``low`` and ``at``; empty where the last word is the name."""
    m = next(filter(None, (_NAME_TYPE.match(text, i, at) for i in _declared_from(text, at, low))), None)
    if not m or m["name"].lower() in _KEYWORDS:
        return ""
    key, name, kind = (m["key"] or "").lower(), m["name"], m["type"]
    if key in ("var", "declare"):
        return name
    if name.lower() in _TYPES_FIRST:
        return ""
    if re.split(r"[(<{]|\]", kind.lower().lstrip("*"))[-1] in _TYPES_LAST or kind.lower().split("(")[0] in _TYPES_LAST:
        return name
    return name if key and name[0].islower() and (kind[0].isupper() or not kind[0].isalpha() or "." in kind) else ""


def name_weight(name: str) -> int:
    """The largest sum of weights of the words of a name, or of two written as one."""
    words = [w.lower() for w in _WORD.findall(name)]
    alone = sum(NAME_WEIGHT.get(w, 0) for w in dict.fromkeys(words))
    pairs = max((NAME_WEIGHT.get(a + b, 0) for a, b in zip(words, words[1:])), default=0)
    return max(alone, pairs)


_INSIDE = re.compile("|".join(p if len(set(p)) > 1 else f"{p}+" for p in map(re.escape, PLACEHOLDERS)), re.I)
_RUN = re.compile(r"[A-Za-z0-9]{6,}")
#: Character counts of a longer value are scaled down: only their shares matter then.
_LARGE = 1e12


class Value:
    """What judging a value needs, added up over its parts, however often constants were joined.

    The joined text itself is never built: a name doubled on each of n lines would make 2^n characters.
    Parts are the values and spans joined here; characters are counted by their low eight bits.
    """

    __slots__ = ("parts", "length", "counts", "start", "digit", "letter", "space", "placeholder", "random")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        self.parts: list = [] if span is None else [span]
        self.length = float(len(text))
        self.counts: dict[int, float] = {}
        for c in text:
            self.counts[ord(c) & 255] = self.counts.get(ord(c) & 255, 0.0) + 1.0
        self.start = text[:1]
        self.digit, self.letter = any(c.isdigit() for c in text), any(c.isalpha() for c in text)
        self.space = any(c.isspace() for c in text)
        rest = _WORD.sub(lambda m: " " if m.group().lower() in PLACEHOLDER_WORDS else m.group(), _INSIDE.sub(" ", text))
        self.placeholder = rest != text
        mixed = lambda r: any(c.isdigit() for c in r) and any(c.isalpha() for c in r)
        self.random = any(mixed(r) or len(r) < 3 * len(_WORD.findall(r)) for r in _RUN.findall(rest))

    def add(self, other: Value) -> None:
        if not self.length:
            self.start = other.start
        self.parts.append(other)
        self.length += other.length
        for c, n in other.counts.items():
            self.counts[c] = self.counts.get(c, 0.0) + n
        if self.length > _LARGE:
            self.length /= 1e6
            self.counts = {c: n / 1e6 for c, n in self.counts.items()}
        for flag in ("digit", "letter", "space", "placeholder", "random"):
            setattr(self, flag, getattr(self, flag) or getattr(other, flag))

    def weight(self) -> int:
        """How much the value looks like a secret: length, mixed characters, entropy; less for words and stand-ins.

        A stand-in has a placeholder in one of its parts and no part with anything beside it that looks random:
        a run of mixed letters and digits, or of very short words.
        """
        if self.length < 6 or self.start in ("$", "<", "{", "%") or (self.placeholder and not self.random):
            return -9
        total = sum(self.counts.values())
        entropy = -sum(c / total * math.log2(c / total) for c in self.counts.values())
        return (self.length >= 8) + (self.digit and self.letter) + (entropy >= 3) - 2 * self.space


def value_weight(value: str) -> int:
    """The weight of one literal."""
    return Value(value).weight()


def _report(value: Value, found: set[tuple[int, int]], seen: set[int]) -> None:
    """Add the spans of a value; ``seen`` are values reported before, so that all calls together visit each once."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple):
            found.add(v)
        elif id(v) not in seen:
            seen.add(id(v))
            todo += v.parts


def _expression(text: str, at: int, known: dict[str, Value]) -> tuple[Value, bool] | None:
    """The value of the expression that starts at ``at``, and whether all of it is constant."""
    value, sure = Value(), True
    while m := _TERM.match(text, at):
        if (g := m.lastindex) < 3:
            value.add(Value(m.group(g), m.span(g)))
        elif m.group(3) in known:
            value.add(known[m.group(3)])
        else:
            value.add(Value(m.group(3), m.span(3)))
            sure = False
        more = _JOIN.match(text, m.end())
        if not more:
            break
        at = more.end()
    return (value, sure) if value.parts else None


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals assigned to sensitive names, constants followed."""
    known: dict[str, Value] = {}
    found: set[tuple[int, int]] = set()
    reported: set[int] = set()
    judged: list[Value] = []  # kept, so that an id names one value only
    typed: dict[int, str] = {}  # names of typed targets by the place of their ``=``
    skip = low = 0  # low: behind the last ``=`` or line end, so that looking back costs one pass in all
    for m in _MARK.finditer(text):
        at, end = m.span()
        if at < skip:
            continue
        before, after = text[at - 1] if at else " ", text[end] if end < len(text) else " "
        if text[at] == "=" and at not in typed and (after == "=" or before in "=!<>"):
            continue  # a comparison
        if text[at] == ":" and (after in "/:" or before == ":"):
            continue  # a URL or a scope
        if after in "=>":  # := and =>
            end += 1
            skip = end
        name = typed.pop(at, "")
        of_type = bool(name)
        if text[at] == ":" and end == at + 1:
            kind = _TYPE.match(text, end)
            if kind and (whose := _target(text, at - (before in "?!"))):
                typed[kind.end()] = whose
                if not kind["quoted"]:
                    skip = kind.end()
                    continue
        elif not of_type:
            low = max(low, text.rfind("\n", low, at) + 1)
            name = _name_before_type(text, at, low)
            low = end
        name = name or _target(text, at)
        if not name:
            continue
        start = _GAP.match(text, end).end()
        weight = name_weight(name)
        if not weight and text[start : start + 1] not in ("'", '"') and not known:
            continue
        got = _expression(text, start, known)
        if got is None:
            continue
        value, sure = got
        if sure and _NAME.fullmatch(name):
            known[name] = value
        if weight and weight + value.weight() >= LEAST:
            judged.append(value)
            _report(value, found, reported)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base matches as (start, end, kind), kind by kind."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def _listed(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def _scanner():
    def scan(texts: pa.Array) -> list[pa.Array]:
        counts: list[list[int]] = [[], [], []]
        base_lists, all_lists = [], []
        for text in texts.to_pylist():
            base = base_spans(text)
            for n, kind in zip(counts, KINDS):
                n.append(sum(s[2] == kind for s in base))
            more = [(a, b, "literal") for a, b in literals(text) if not any(s <= a and b <= e for s, e, _ in base)]
            base_lists.append(_listed(base))
            all_lists.append(_listed(base + more))
        return [*(pa.array(n, pa.int64()) for n in counts), pa.array(base_lists, pa.string()), pa.array(all_lists, pa.string())]

    return scan


def scan_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents with n_assign, n_access, n_hex, base_spans and spans (``kind:start:end``, comma-joined).

    Positions are code points, the end exclusive. A null or empty text has no spans. Repeated rows are
    scanned each. A text is lexed in one pass in the order of its assignments, however long it is.
    """
    return mapped(docs, _scanner, "n_assign long, n_access long, n_hex long, base_spans string, spans string", keep)


def digest(col: str):
    return F.sha2(F.col(col).cast("binary"), 256)
