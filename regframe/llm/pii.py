"""Personal data: base patterns, and an offset-preserving deobfuscation.

Besides the plain text, each text is read through transducers that undo disguises:
look-alike letters and full-width forms become ASCII, invisible characters vanish,
``[at]`` and ``(dot)`` and spelled forms between address parts become ``@`` and
``.``, and runs of spelled digits become digits. Each emitted character keeps the
source span it came from, so an identifier found in the normalised text is mapped
back to code points of the source. Such spans are added where no base span holds
them; base spans always stay.

Every search is linear in the text: an address is grown left from its ``@``, other
patterns start at the first digit of a run only.

Defined cases: a null text is empty and has no spans; an empty table gives no rows;
repeated rows each get their row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        # what stands before this @ cannot start a later match: @ is no part of a local name
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


FINDERS = (_emails, _ips, _cards, _phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    return [(k, s, e) for k, f in enumerate(FINDERS) for s, e in f(text)]


# --- deobfuscation -------------------------------------------------------------

#: Letters of other scripts that look like ASCII ones (fixed values).
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ι": "I", "Ο": "O", "Ρ": "P",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_DIGIT = "|".join(DIGIT_WORDS) + "|oh"
_WIDE = "！-～①-⑨"
_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + INVISIBLE + _WIDE + "٠-٩०-९" + "]")
#: Disguised marks: bracketed anywhere, plain words only between name parts that end
#: in a common top-level domain (fixed values; none is a frequent English word), or in
#: two to six letters where neither name nor host is a common word.
_AT = re.compile(r"\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>)\s*", re.I)
_DOT = re.compile(r"\s*(?:\[\s*(?:dot|\.)\s*\]|\(\s*(?:dot|\.)\s*\)|\{\s*dot\s*\}|<\s*dot\s*>)\s*", re.I)
_PLAIN = re.compile(
    r"(?<![\w.])(?P<name>[A-Za-z0-9._%+-]{1,64}(?:\s+dot\s+[A-Za-z0-9._%+-]{1,64}){0,4})(?P<at>\s+at\s+)"
    r"(?P<host>[A-Za-z0-9-]{1,63}(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]{1,63}){0,4})(?P<dot>\s+dot\s+|\.)(?P<top>[A-Za-z]{2,6})(?!\w)",
    re.I,
)
_TOPS = frozenset("com org net edu gov mil info biz io dev app uk de fr nl eu ch ru cn jp br".split())
#: Words that stand before "at" or after it in running text.
_COMMON = frozenset(
    "a about after all also am an and any are arrive arrived as available back be been before being but buy by can click "
    "code contact details directly docs documentation download each every find first for found free from get go good "
    "had has have he her here him his home hosted i in information is it its last learn listed live located look "
    "looked looking looks me meet met more my next no not now of off on one online only open or order our out page "
    "play point posted published read see seen she shop site so start started stay store that the their them then "
    "there these they this those time to today up us visit was watch we website were what when where which who will "
    "with work worked working works you your".split()
)
_IP_DOTS = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\s+dot\s+|\.)[0-9]{1,3}){3}(?![\w])", re.I)
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s,.-]+)?(?:(?:{_DIGIT}|[0-9]+)[\s,.-]+){{6,}}(?:{_DIGIT}|[0-9]+)(?!\w)", re.I)
_GROUP = rf"(?:{_DIGIT}|[0-9]{{1,3}})(?:[\s,-]+(?:{_DIGIT}|[0-9]{{1,3}})){{0,2}}"
_SPELLED_IP = re.compile(rf"(?<![\w.]){_GROUP}(?:(?:\s+dot\s+|\.){_GROUP}){{3}}(?!\w)", re.I)
_WORD_DOT = re.compile(r"\s+dot\s+", re.I)
_TOKEN = re.compile(rf"plus|{_DIGIT}|[0-9]+", re.I)


class Tape:
    """A text with, for each of its characters, the source span it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.at = [(i, i + 1) for i in range(len(text))]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans (ordered, apart); a new character stands for the whole span."""
        if not edits:
            return
        out, at, last = [], [], 0
        for s, e, new in edits:
            out.append(self.text[last:s])
            at += self.at[last:s]
            if new:
                out.append(new)
                at += [(self.at[s][0], self.at[e - 1][1])] * len(new)
            last = e
        out.append(self.text[last:])
        self.at = at + self.at[last:]
        self.text = "".join(out)

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.at[s][0], self.at[e - 1][1]


def _letters(tape: Tape) -> None:
    edits = []
    for m in _ODD.finditer(tape.text):
        c = m[0]
        new = "" if c in INVISIBLE else LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if len(new) == 1 and not new.isascii() and new.isdigit():
            new = str(unicodedata.digit(new))
        edits.append((m.start(), m.end(), new))
    tape.rewrite(edits)


def _address(m: re.Match) -> bool:
    """Whether a plain "at" stands between a name and a host."""
    hosts = re.split(r"\s+dot\s+|\.", m["host"], flags=re.I)
    top, plain = m["top"].lower(), m["dot"] != "."
    if plain and top in _TOPS:
        return True
    # "at the dot on", or a sentence that begins without a space
    if top not in _TOPS and (plain and top in _COMMON or not (m["top"].islower() or m["top"].isupper())):
        return False
    return not {m["name"].lower(), *map(str.lower, hosts)} & _COMMON and any(c.isalnum() for c in m["name"])


def _marks(tape: Tape) -> None:
    for pattern, new in ((_AT, "@"), (_DOT, ".")):
        tape.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(tape.text)])
    edits = []
    for m in _PLAIN.finditer(tape.text):
        if not _address(m):
            continue
        edits += [(m.start("name") + d.start(), m.start("name") + d.end(), ".") for d in _WORD_DOT.finditer(m["name"])]
        edits.append((*m.span("at"), "@"))
        edits += [(m.start("host") + d.start(), m.start("host") + d.end(), ".") for d in _WORD_DOT.finditer(m["host"])]
        edits.append((*m.span("dot"), "."))
    tape.rewrite(edits)
    edits = []
    for m in _IP_DOTS.finditer(tape.text):
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _WORD_DOT.finditer(m[0])]
    tape.rewrite(edits)


def _digit(token: str) -> str:
    w = token.lower()
    return "+" if w == "plus" else "0" if w == "oh" else w if w.isdigit() else str(DIGIT_WORDS.index(w))


def _numbers(tape: Tape) -> None:
    edits = []
    for m in _SPELLED_IP.finditer(tape.text):
        last = None
        for t in _TOKEN.finditer(m[0]):
            if last is not None:
                gap = m[0][last : t.start()]
                edits.append((m.start() + last, m.start() + t.start(), "." if "." in gap or "dot" in gap.lower() else ""))
            edits.append((m.start() + t.start(), m.start() + t.end(), _digit(t[0])))
            last = t.end()
    tape.rewrite([e for e in edits if e[0] < e[1]])
    edits = []
    for m in _SPELLED.finditer(tape.text):
        if not any(c.isalpha() for c in m[0]):
            continue
        last = None
        for t in _TOKEN.finditer(m[0]):
            new = _digit(t[0])
            if last is not None:
                edits.append((m.start() + last, m.start() + t.start(), ""))
            edits.append((m.start() + t.start(), m.start() + t.end(), new))
            last = t.end()
    tape.rewrite([e for e in edits if e[0] < e[1]])


_DISGUISED = re.compile(
    rf"[\[({{<]\s*(?:at|dot|\.)\s*[\])}}>]|\sdot\s|\sat\s+[a-z0-9-]+\.[a-z]"
    rf"|\b(?:{_DIGIT})[\s,.-]+(?:{_DIGIT}|[0-9])|[0-9][\s,.-]+(?:{_DIGIT})\b",
    re.I,
)


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of disguised identifiers, mapped back to the source."""
    if not (_DISGUISED.search(text) or not text.isascii() and _ODD.search(text)):
        return []
    tape = Tape(text)
    for step in (_letters, _marks, _numbers):
        step(tape)
    if tape.text == text:
        return []
    return [(k, *tape.source(s, e)) for k, s, e in base_spans(tape.text)]


def find(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, each (kind number, start, end) by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    more = []
    for k, s, e in hidden_spans(text):
        if not any(bs <= s and e <= be for _, bs, be in base):
            more.append((k, s, e))
    return base, sorted(set(base + more))


_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)


def scan(docs: DataFrame, *, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per document: struct ``row``, ``base`` and ``spans`` (kind number, start, end)."""
    out = T.StructType([T.StructField("base", _SPANS), T.StructField("spans", _SPANS)])
    kind = common.to_arrow_schema(out).field("base").type

    def fn(texts: list) -> dict:
        got = [find(t) for t in texts]
        as_dicts = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        return {n: pa.array([as_dicts(g[i]) for g in got], kind) for i, n in enumerate(("base", "spans"))}

    return common.map_texts(docs, fn, out, text=text, carry=carry)


def as_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
