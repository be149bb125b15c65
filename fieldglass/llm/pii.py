"""Personal data by offset-preserving deobfuscation.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers as they stand. Then two transducers
rewrite disguises, the first homoglyphs, full-width characters and spelled digits, the second "at" and "dot": words or
signs in brackets, and bare words beside what looks like a host name or an address in numbers. Each keeps for a
rewritten run the source characters it came from. The same patterns run over the rewritten text, and what they find is
mapped back to source characters. Added spans never touch base spans.

Whole texts are read, null as empty; all patterns take time in proportion to the text. Rows are independent: repeated
rows and null doc_ids give results of their own, an empty table an empty one, extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The address pattern so that a long run of digits is read once: a match can only begin where a run does.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "·": ".", "•": ".", "﹫": "@", "﹒": ".", "\xa0": " ", " ": " ", " ": " ",
}
#: Characters that are not seen.
UNSEEN = "​‌‍⁠﻿\xad"
GLYPHS = {
    **LOOKALIKES,
    **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)},
    **{chr(0x2460 + i): str(i + 1) for i in range(9)},
    "⓪": "0",
    **{chr(0x0660 + i): str(i) for i in range(10)},
    **{chr(0x06F0 + i): str(i) for i in range(10)},
    **{c: "" for c in UNSEEN}
}
#: Mathematical digits: five alphabets of ten.
GLYPHS |= {chr(0x1D7CE + i): str(i % 10) for i in range(50)}

DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def trie(words: Iterable[str]) -> str:
    """A pattern for any of the words that reads a common beginning once."""
    ends, after = "" in words, {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    ways = "|".join(re.escape(c) + trie(rest) for c, rest in sorted(after.items()))
    return f"(?:{ways})?" if ends and ways else f"(?:{ways})" if ways else ""


_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: A run of three or more spelled digits, with single spaces, commas or hyphens between; "plus" may lead.
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,-]{{1,2}})?(?:(?:{_WORD}|[0-9])[ ,-]{{1,2}}){{2,}}(?:{_WORD}|[0-9])(?!\w)", re.I)
#: What any such run holds, in lower case: two of its digits and what stands before them. A cheap test for the few texts with runs.
SPELLED_HINT = re.compile(rf"[ ,-](?:{trie(DIGIT_WORDS)}|[0-9])[ ,-]{{1,2}}(?:{trie(DIGIT_WORDS)}|[0-9])(?!\w)")
SPELLED_PART = re.compile(rf"plus|{_WORD}|[0-9]|[ ,-]+", re.I)
_AT, _DOT = "at|arroba", "dot|punkt|point|punto"
#: A bracketed "at" or "dot", as a word or a sign.
BRACKET = re.compile(rf"\s?[\[({{<]\s?(?:(?P<at>{_AT}|@)|{_DOT}|\.)\s?[\])}}>]\s?", re.I)
_BRACKET_DOT = rf"\s?[\[({{<]\s?(?:{_DOT}|\.)\s?[\])}}>]\s?"
DOT = re.compile(rf" (?:{_DOT}) |{_BRACKET_DOT}", re.I)
BARE_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-]) (?:{_AT}) (?=[A-Za-z0-9])", re.I)
#: What may follow an "at": labels with dots, plain or disguised, the last in letters of one case.
HOST = re.compile(
    rf"(?i:(?!www\.)[A-Z0-9-]++(?:(?:\.| (?:{_DOT}) |{_BRACKET_DOT})(?!(?:{_DOT}|{_AT}) )[A-Z0-9-]++)*)(?:\.|(?i: "
    rf"(?:{_DOT}) |{_BRACKET_DOT}))(?:[a-z]{{2,24}}|[A-Z]{{2,24}})(?![A-Za-z0-9])(?!/|:[/0-9])"
)
NUMBERS = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\.| (?:{_DOT}) |{_BRACKET_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_OCTET = rf"(?:{_WORD}|[0-9])(?:[ ,-](?:{_WORD}|[0-9])){{0,2}}"
#: Four spelled numbers of up to three digits with "dot" between.
SPELLED_IP = re.compile(rf"(?<!\w){_OCTET}(?: (?:{_DOT}) {_OCTET}){{3}}(?!\w)", re.I)
SPELLED_IP_PART = re.compile(rf" (?:{_DOT}) |{_WORD}|[0-9]|[ ,-]", re.I)
#: Endings of hosts that a bare "dot" may stand before.
SUFFIXES = {
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "app", "dev", "io", "ai", "co", "eu", "uk", "us", "ca", "au", "nz", "ie",
    "de", "at", "ch", "fr", "be", "lu", "nl", "es", "pt", "it", "mx", "ar", "cl", "br", "pl", "cz", "dk", "se", "no", "fi", "ru", "jp", "cn", "in", "example", "test",
}
GLYPH = re.compile("[" + "".join(re.escape(c) for c in GLYPHS) + "]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, looked for around each @: the leftmost start is the longest run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the four kinds; a match that fails its check is dropped."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in PATTERNS["card"].finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PATTERNS["phone"].finditer(text):
            if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _spelled(m: re.Match) -> list[tuple[int, int, str]]:
    """Edits that turn spelled digits into digits, separators between them into nothing or one space."""
    if not re.search(r"[A-Za-z]{2}", m[0]):
        return []
    out = []
    for p in SPELLED_PART.finditer(m[0]):
        w = p[0].lower()
        new = "+" if w == "plus" else DIGIT_WORDS.get(w, w if w.isdigit() else "-" if "-" in w else "")
        out.append((m.start() + p.start(), m.start() + p.end(), new))
    return out


def characters(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of look-alike characters and spelled digits."""
    found = [] if text.isascii() else [(m.start(), m.end(), GLYPHS[m[0]]) for m in GLYPH.finditer(text)]
    low = text.casefold()
    if any(f" {w} " in low for w in _DOT.split("|")):
        for m in SPELLED_IP.finditer(text):
            if re.search(r"[A-Za-z]{2}", re.sub(rf" (?:{_DOT}) ", "", m[0], flags=re.I)):
                for p in SPELLED_IP_PART.finditer(m[0]):
                    w = p[0].lower()
                    new = "." if len(w) > 3 and w[0] == " " else DIGIT_WORDS.get(w, w if w.isdigit() else "")
                    found.append((m.start() + p.start(), m.start() + p.end(), new))
    if SPELLED_HINT.search(low):
        for m in SPELLED.finditer(text):
            found += _spelled(m)
    return found


def _plain_at(text: str, at: int, host: re.Match) -> bool:
    """Whether a bare "at" is prose: what stands before it is a plain word and no spelled dot leads to a known ending of a host."""
    local = re.search(r"[A-Za-z0-9._%+-]+\Z", text[max(0, at - 64) : at])
    if local and re.search(r"[0-9_%+.-]", local[0]):
        return False
    return not DOT.search(host[0]) or re.search(r"[A-Za-z]+\Z", host[0])[0].lower() not in SUFFIXES


def ats_and_dots(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of disguised "at" and "dot"."""
    found, low = [], text.casefold()
    brackets = "[" in text or "(" in text or "{" in text or "<" in text
    bare_at, bare_dot = (any(f" {w} " in low for w in words.split("|")) for words in (_AT, _DOT))
    if not (brackets or bare_at or bare_dot):
        return found
    ats = [m.end() for m in re.finditer("@", text)] if "@" in text else []
    if brackets:
        for m in BRACKET.finditer(text):
            found.append((m.start(), m.end(), "@" if m["at"] else "."))
            if m["at"]:
                ats.append(m.end())
    if bare_at:
        for m in BARE_AT.finditer(text):
            host = HOST.match(text, m.end())
            if host and not _plain_at(text, m.start(), host):
                found.append((m.start(), m.end(), "@"))
                ats.append(m.end())
    if not (brackets or bare_dot):
        return found
    for at in ats:
        if m := HOST.match(text, at):
            found += [(d.start(), d.end(), ".") for d in DOT.finditer(text, at, m.end())]
    for m in NUMBERS.finditer(text):
        found += [(d.start(), d.end(), ".") for d in DOT.finditer(text, m.start(), m.end())]
    return found


class Rewriting:
    """A text after disjoint edits, and where its characters come from."""

    def __init__(self, text: str, found: list[tuple[int, int, str]]):
        parts, self.norm_at, self.src_at, self.ends, last, length = [], [], [], [], 0, 0
        for s, e, new in sorted(found):
            if s < last:
                continue
            parts += [text[last:s], new]
            self.norm_at += [length, length + s - last]
            self.src_at += [(last, True), (s, False)]
            self.ends.append(e)
            length += s - last + len(new)
            last = e
        self.text = "".join([*parts, text[last:]]) if parts else text
        self.norm_at.append(length)
        self.src_at.append((last, True))

    def source(self, p: int, end: bool) -> int:
        """Where the character at p (for an end: the last character before p) begins (ends) in the source."""
        q = p - end
        i = bisect.bisect_right(self.norm_at, q) - 1
        s, kept = self.src_at[i]
        if kept:
            return s + q - self.norm_at[i] + end
        return self.ends[i // 2] if end else s


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only the rewritten text shows, in source characters, apart from base spans and each other."""
    first = Rewriting(text, characters(text))
    second = Rewriting(first.text, ats_and_dots(first.text))
    if second.text == text:
        return []
    taken = sorted((s, e) for s, e, _ in base)
    out = []
    for s, e, kind in sorted(base_spans(second.text)):
        s, e = first.source(second.source(s, False), False), first.source(second.source(e, True), True)
        i = bisect.bisect_left(taken, (s, s))
        if (i < len(taken) and taken[i][0] < e) or (i and taken[i - 1][1] > s):
            continue
        bisect.insort(taken, (s, e))
        out.append((s, e, kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans as kind:start:end of base and of added ones, and counts of base kinds; see the contract of op6."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                both = joined(base + added_spans(text, base))
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), both))
            made = pd.DataFrame(out, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            made.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield made

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str | None) -> str | None:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted(base + added_spans(text, base), key=lambda x: (x[0], -x[1]))
    out, last = [], 0
    for s, e, kind in spans:
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` replaced; n_chars, where docs has it, follows the new text."""
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(redact, na_action="ignore")

    out = docs.withColumn("text", F.pandas_udf(scan, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
