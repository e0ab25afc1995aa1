"""The block style of YAML that front matter is written in: read to plain values, and written in one fixed form.

Read: maps, lists, lists of maps, `|` and `>` blocks with - and +, quoted and plain scalars over several lines, flow lists
and maps on one line, comments. Dates stay texts. Anchors, tags and several documents are errors, as are tabs that
indent and lines that fit nowhere. Repeated keys: the last stands.
"""

from __future__ import annotations

import json
import re

_NUMBER = re.compile(r"[-+]?(0|[1-9][0-9_]*)$")
_FLOAT = re.compile(r"[-+]?([0-9][0-9_]*)?\.[0-9_]*([eE][-+][0-9]+)?$")
#: Texts that stand for other values.
WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None}
TRUE, FALSE = ("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"), ("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@`-][^#:]*?|-[^\s#:][^#:]*?|[^\s'"\[{&*!|>%@`-](?:[^:#]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([-+]?)$")


class YamlError(ValueError):
    pass


def scalar(text: str) -> object:
    """A plain or quoted scalar."""
    if text[:1] == '"':
        try:
            return json.loads(re.sub(r"(?s)\\(.)", lambda m: {"x": "\\u00", "e": "\\u001b", "0": "\\u0000"}.get(m[1], m[0] if m[1] in '"\\/bfnrtu' else m[1]), text), strict=False)
        except ValueError:
            raise YamlError(f"bad quotes: {text[:40]}") from None
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise YamlError(f"bad quotes: {text[:40]}")
        return text[1:-1].replace("''", "'")
    if text in WORDS:
        return WORDS[text]
    if text in TRUE or text in FALSE:
        return text in TRUE
    if _NUMBER.match(text):
        return int(text.replace("_", ""))
    if _FLOAT.match(text) and any(c.isdigit() for c in text):
        return float(text.replace("_", ""))
    if text[:1] in "&*!%@`":
        raise YamlError(f"not read: {text[:40]}")
    return text


def _flow(text: str, at: int) -> tuple[object, int]:
    """A value of flow style from `at` on, and where it ends."""
    while at < len(text) and text[at] == " ":
        at += 1
    if at < len(text) and text[at] in "[{":
        close, out = "]}"["[{".index(text[at])], [] if text[at] == "[" else {}
        at += 1
        while True:
            while at < len(text) and text[at] in " ,":
                at += 1
            if at >= len(text):
                raise YamlError(f"not closed: {text[:40]}")
            if text[at] == close:
                return out, at + 1
            value, at = _flow(text, at)
            if isinstance(out, dict):
                while at < len(text) and text[at] == " ":
                    at += 1
                inner = None
                if at < len(text) and text[at] == ":":
                    inner, at = _flow(text, at + 1)
                out[str(value)] = inner
            else:
                out.append(value)
    if at < len(text) and text[at] in "\"'":
        m = re.compile(r'"(?:[^"\\]|\\.)*"' if text[at] == '"' else r"'(?:[^']|'')*'").match(text, at)
        if not m:
            raise YamlError(f"not closed: {text[:40]}")
        return scalar(m[0]), m.end()
    m = re.compile(r"(?:[^,\[\]{}:]|:(?=\S))*").match(text, at)
    return scalar(m[0].strip()), m.end()


def _bare(text: str) -> str:
    """A line's value without its comment."""
    if text[:1] in "\"'":
        m = re.match(r'("(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\')\s*(#.*)?$', text)
        return m[1] if m else text
    return re.sub(r"(^|\s)#.*$", "", text).strip()


class _Reader:
    def __init__(self, text: str):
        self.lines = text.removesuffix("\n").split("\n")
        self.at = 0

    def _peek(self) -> tuple[int, str] | None:
        """Indentation and content of the next line that is not empty or a comment."""
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip("\r")
            content = line.lstrip(" ")
            if content and not content.startswith("#") and content.strip():
                if content[0] == "\t":
                    raise YamlError(f"line {self.at + 1}: a tab indents")
                return len(line) - len(content), content.rstrip()
            self.at += 1
        return None

    def block(self, indent: int) -> object:
        found = self._peek()
        if found is None or found[0] < indent:
            return None
        own, content = found
        if content == "-" or content.startswith("- "):
            return self._list(own)
        if _KEY.match(content):
            return self._map(own)
        return self._value(content, own, -1)

    def _list(self, indent: int) -> list:
        out = []
        while (found := self._peek()) and found[0] == indent and (found[1] == "-" or found[1].startswith("- ")):
            rest = found[1][1:].lstrip(" ")
            if not _bare(rest):
                self.at += 1
                out.append(self.block(indent + 1))
                continue
            # What follows the dash stands as a line of its own, indented by what was taken off.
            inner = indent + len(found[1]) - len(rest)
            if _KEY.match(rest) or rest == "-" or rest.startswith("- "):
                self.lines[self.at] = " " * inner + rest
                out.append(self.block(inner))
            else:
                out.append(self._value(rest, indent, indent))
        if (found := self._peek()) and found[0] > indent:
            raise YamlError(f"line {self.at + 1} fits nowhere")
        return out

    def _map(self, indent: int) -> dict:
        out: dict = {}
        while (found := self._peek()) and found[0] == indent:
            m = _KEY.match(found[1])
            if not m:
                raise YamlError(f"line {self.at + 1} is no `key: value`")
            key = scalar(m[1]) if m[1][0] in "\"'" else m[1]
            rest = found[1][m.end() :].strip()
            if _bare(rest):
                out[key] = self._value(rest, indent, indent)
                continue
            self.at += 1
            following = self._peek()
            lower = following and following[0] == indent and (following[1] == "-" or following[1].startswith("- "))
            out[key] = self._list(indent) if lower else self.block(indent + 1)
        if (found := self._peek()) and found[0] > indent:
            raise YamlError(f"line {self.at + 1} fits nowhere")
        return out

    def _value(self, text: str, indent: int, outer: int) -> object:
        """A scalar or flow value that begins on this line; deeper lines go on with it."""
        self.at += 1
        block = _BLOCK.match(_bare(text))
        if block:
            return self._literal(block[1], block[2], indent)
        text = _bare(text)
        while self.at < len(self.lines):
            line = self.lines[self.at]
            content = line.strip()
            if not content or len(line) - len(line.lstrip(" ")) <= outer or content.startswith("#"):
                break
            if _KEY.match(content) and text[:1] not in "\"'[{":
                raise YamlError(f"line {self.at + 1} fits nowhere")
            text += " " + _bare(content)
            self.at += 1
        if text[:1] in "[{":
            value, end = _flow(text, 0)
            if text[end:].strip():
                raise YamlError(f"after the end: {text[end:][:40]}")
            return value
        return scalar(text)

    def _literal(self, style: str, chomp: str, indent: int) -> str:
        taken: list[str] = []
        while self.at < len(self.lines):
            line = self.lines[self.at].rstrip("\r")
            if line.strip() and len(line) - len(line.lstrip(" ")) <= indent:
                break
            taken.append(line)
            self.at += 1
        depth = min((len(x) - len(x.lstrip(" ")) for x in taken if x.strip()), default=0)
        lines = [x[depth:] for x in taken]
        body = "\n".join(lines).rstrip("\n")
        trailing = len(lines) - len(body.split("\n")) if body else len(lines)
        if style == ">":
            body = re.sub(r"(?<=\S)\n(\n*)(?=\S)", lambda m: m[1] or " ", body)
        end = {"-": "", "+": "\n" * (trailing + 1), "": "\n"}[chomp]
        return body + end if body else (end if chomp == "+" else "")


def load(text: str) -> object:
    reader = _Reader(text)
    value = reader.block(0)
    if reader._peek() is not None:
        raise YamlError(f"line {reader.at + 1} fits nowhere")
    return value


# ---------------------------------------------------------------- writing

_PLAIN = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`=~.0-9+][^\n]*|[-?:][^\s,\[\]{}][^\n]*|[.0-9+=~][^\n]*", re.S)
_DATE = re.compile(r"\d{4}-\d\d?-\d\d?([Tt ].*)?$")
_OTHER = re.compile(r"[-+]?(0[xb][0-9a-fA-F_]+|0o?[0-7_]+|[0-9][0-9_]*(:[0-5]?[0-9])+(\.[0-9_]*)?|\.(inf|Inf|INF)|\.(nan|NaN|NAN))$|[<=]<?$")


def _text(value: str, indent: int) -> str:
    if "\n" in value and not re.search(r"[^\S\n ]|[ ]\n|^\s|[\x00-\x08\x0b-\x1f\x7f]", value) and value.strip():
        mark = "|" if value.endswith("\n") else "|-"
        if value.endswith("\n\n"):
            mark = "|+"
        pad = " " * indent
        return mark + "\n" + "\n".join(pad + x if x else "" for x in (value[:-1] if value.endswith("\n") else value).split("\n"))
    if re.search(r"[\x00-\x1f\x7f\x85\u2028\u2029]", value):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f").replace("\x85", "\\u0085").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    odd = not _PLAIN.fullmatch(value) or value != value.strip() or ": " in value or " #" in value or value.endswith(":") or _DATE.match(value) or _OTHER.match(value)
    if odd or not isinstance(scalar(value), str) or value.startswith(("---", "...")):
        return "'" + value.replace("'", "''") + "'"
    return value


def _written(value: object, indent: int) -> str:
    """The value as it follows `key:` or `-`: on the line, or below it."""
    if isinstance(value, dict) and value:
        return "\n" + _lines(value, indent)
    if isinstance(value, list) and value:
        return "\n" + _items(value, indent - 2)
    return " " + _inline(value, indent)


def _inline(value: object, indent: int) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return _text(value, indent)
    if isinstance(value, float):
        text = repr(value)
        return text.replace("e", ".0e") if "." not in text and "e" in text else text
    return {"{}": "{}", "[]": "[]"}.get(str(value), str(value))


def _items(values: list, indent: int) -> str:
    pad = " " * indent
    out = []
    for v in values:
        inner = _lines(v, indent + 2) if isinstance(v, dict) and v else _items(v, indent + 2) if isinstance(v, list) and v else None
        out.append(f"{pad}- {inner.lstrip(' ')}" if inner else f"{pad}- {_inline(v, indent + 2)}")
    return "\n".join(out)


def _lines(value: dict, indent: int) -> str:
    pad = " " * indent
    return "\n".join(f"{pad}{_text(str(k), 0)}:{_written(v, indent + 2)}" for k, v in value.items())


def dump(value: dict, first: list[str] | tuple[str, ...] = ()) -> str:
    """A map in block style: keys in `first` in that order, then the others as they come. Lines are not folded."""
    ordered = {k: value[k] for k in first if k in value} | {k: v for k, v in value.items() if k not in first}
    return _lines(ordered, 0) + "\n" if ordered else ""
