"""Offset-preserving deobfuscation of personal data.

Base detectors find plain identifiers. Beside them a chain of transducers rewrites a text and
keeps, for every piece of the rewritten text, the range of the source that it came from:
character references become characters, look-alike letters and digits become ASCII and invisible
characters go, spelled digits become digits, and "at" and "dot" disguises become signs; unless one of these is in brackets, the
address must end in a known top-level domain. The same detectors run over the rewritten text;
what they find there is mapped back to source characters and added where a rewrite took part.

A text is handled in its own row: nothing is shuffled. All scans are linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fairlead.llm.common import slices

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones, with those.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Digits spelled in four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words that repeat the digit after them, and spelled digits that are articles too.
TIMES = {"double": 2, "triple": 3, "doble": 2, "doppel": 2}
ARTICLES = frozenset(("un", "uno", "one"))
AT_WORDS, DOT_WORDS = "at|arroba|arobase|klammeraffe|at-sign|at sign", "dot|punto|punkt|point|d0t"

CHARACTERS = str.maketrans({**LOOK_ALIKES, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, **{chr(z + d): str(d) for z in (0x660, 0x6F0, 0x966) for d in range(10)}})
ODD = re.compile("[" + re.escape("".join(map(chr, CHARACTERS)) + INVISIBLE) + "]")
REFERENCE = re.compile(r"&(?:#0{0,5}([0-9]{2,3})|#[xX]0{0,5}([0-9a-fA-F]{2})|(commat|period));?")
DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
GAP = r"[ \t\n,./()-]{1,3}"
OPEN, CLOSE = r"[\[({<]", r"[\])}>]"
BRACKETED = rf"[ \t]*{OPEN}[ \t]*(?:{DOT_WORDS}|\.)[ \t]*{CLOSE}[ \t]*"
NUMBER = rf"(?:(?:{'|'.join(TIMES)})[ \t]+)?(?:{DIGIT}|[0-9]++)(?![^\W_])"
#: Digits, spelled or not, with what stands between them; dots in words or brackets count.
RUN = re.compile(rf"(?<![^\W_])(?:plus[ \t\n]+{NUMBER}|{NUMBER}(?=[ \t\n,./()\[{{<-]))(?:{BRACKETED}{NUMBER}|{GAP}(?:{NUMBER}|(?:{DOT_WORDS})(?![^\W_])))*", re.I)
WORDS = f"{DIGIT}|{'|'.join(TIMES)}|plus|{DOT_WORDS}"
RUN_HINT = re.compile(rf"\b(?:{WORDS}){GAP}(?:[0-9]|(?:{WORDS})\b)|[0-9]{GAP}(?:{WORDS})\b|[0-9][ \t]*{OPEN}[ \t]*(?:\.|(?:{DOT_WORDS})\b)")
TOKEN = re.compile(rf"[dD]0[tT](?![^\W_])|[0-9]+|[^\W\d_]+|(?<=[\[({{<])[ \t]*\.(?=[ \t]*{CLOSE})")
AT = rf"(?:[ \t]*{OPEN}[ \t]*(?:{AT_WORDS}|@)[ \t]*{CLOSE}[ \t]*|[ \t]+(?:{AT_WORDS})[ \t]+|[ \t]+@[ \t]+|[ \t]+@|@[ \t]+|@)"
DOT = rf"(?:[ \t]*{OPEN}[ \t]*(?:{DOT_WORDS}|\.)[ \t]*{CLOSE}[ \t]*|[ \t]+(?:{DOT_WORDS})[ \t]+|[ \t]+\.[ \t]+|\.)"
DISGUISE = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?P<at>{AT})[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})+", re.I)
IN_LOCAL = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:[ \t]*{OPEN}[ \t]*(?:{DOT_WORDS}|\.)[ \t]*{CLOSE}[ \t]*|[ \t]+(?:{DOT_WORDS})[ \t]+)(?=[A-Za-z0-9_%+-]{{1,63}}{AT}[A-Za-z0-9-])", re.I)
DOTS = re.compile(DOT, re.I)
DISGUISE_HINT = re.compile(rf"{OPEN}[ \t]*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)|\b(?:{AT_WORDS.removeprefix('at|')}|{DOT_WORDS})\b|[ \t]@|@[ \t]")
#: Top-level domains, one of which must close an address without a bracketed sign ("at this point in",
#: "look at the dot product", "@ noon . Then" are prose), and words that are no host names.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es eu ch nl pl pt se dk fi cz ru cn jp ca au br mx".split())
NO_HOSTS = frozenset("the a an one this that these those his her its my our your their some any no each every what which another un una uno der die das ein eine le la les el los las".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses: from each sign back over the local part."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all plain identifiers, by kind and start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((3, *m.span()))
    return found


class Rewritten:
    """A text with, for its changed pieces, the source ranges: lists of (start here, end here,
    source start, source end), in order; what lies between is unchanged."""

    def __init__(self, text: str):
        self.text = text
        self.pieces: list[tuple[int, int, int, int]] = []
        self.starts: list[int] = []

    def back(self, at: int, end: bool) -> int:
        """The source place of a place here; inside a changed piece its outer edge."""
        i = bisect_right(self.starts, at - 1 if end else at) - 1
        if i < 0:
            return at
        a, b, x, y = self.pieces[i]
        if at < b or end and at == b:
            return y if end else x
        return y + (at - b)

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """With the ranges of this text replaced; ranges are sorted and don't overlap."""
        if not edits:
            return self
        new = Rewritten("")
        out, done, size = [], 0, 0
        marks = []
        for a, b, put in edits:
            out += [self.text[done:a], put]
            size += a - done
            marks.append((size, size + len(put), a, b))
            size += len(put)
            done = b
        out.append(self.text[done:])
        new.text = "".join(out)
        # earlier pieces move along; those inside a replaced range are part of it
        moved, k, shift = [], 0, 0
        for p in self.pieces:
            while k < len(marks) and marks[k][3] <= p[0]:
                shift = marks[k][1] - marks[k][3]
                k += 1
            if k < len(marks) and p[1] > marks[k][2]:
                continue
            moved.append((p[0] + shift, p[1] + shift, p[2], p[3]))
        made = [(m[0], m[1], self.back(m[2], False), self.back(m[3], True)) for m in marks]
        new.pieces = sorted(moved + made)
        new.starts = [p[0] for p in new.pieces]
        return new


def references(r: Rewritten) -> Rewritten:
    """Character references of printable ASCII signs to these."""
    edits = []
    for m in REFERENCE.finditer(r.text) if "&" in r.text else ():
        code = int(m[1]) if m[1] else int(m[2], 16) if m[2] else 64 if m[3] == "commat" else 46
        if 32 < code < 127:
            edits.append((m.start(), m.end(), chr(code)))
    return r.apply(edits)


def characters(r: Rewritten) -> Rewritten:
    """Look-alikes to ASCII and invisible characters away."""
    if ODD.search(r.text) is None:
        return r
    edits = []
    for m in ODD.finditer(r.text):
        edits.append((m.start(), m.end(), m[0].translate(CHARACTERS) if m[0] not in INVISIBLE else ""))
    return r.apply(edits)


def digits(r: Rewritten) -> Rewritten:
    """Runs of digits with spelled digits or disguised dots among them to plain ones, where a
    detector then finds something or four digits are in a row of which three are spelled."""
    if RUN_HINT.search(r.text.lower()) is None:
        return r
    edits = []
    for m in RUN.finditer(r.text):
        words = without_articles([(t.start() + m.start(), t.end() + m.start(), t[0].strip().lower()) for t in TOKEN.finditer(m[0])])
        spelled = sum(w in SPELLED for *_, w in words)
        if spelled == len(words) == 1 or all(w.isdigit() for *_, w in words):
            continue
        whole = spelled >= 3 and sum(w in SPELLED or w.isdigit() for *_, w in words) >= 4
        put = []  # start, end, end with the gap behind it, what takes its place
        for (a, b, w), after in zip(words, [*words[1:], None]):
            gap, then = (r.text[b : after[0]], after[2]) if after else ("", ".")
            x = SPELLED.get(w) or ("+" if w == "plus" else w if w.isdigit() else ".")
            if w in TIMES:  # stands for all but one of the digits
                x = SPELLED.get(then, then)[:1] * (TIMES[w] - 1)
            if x not in "+." and w not in TIMES and (then in SPELLED or then in TIMES or then.isdigit()):
                if gap == "." or whole and "." in gap:  # a full stop before a space is prose
                    x += "."
                elif w.isdigit() and then.isdigit() and len(w + then) > 2:
                    x += " "  # two numbers stay two
            put.append((a, b, after[0] if after else b, x))
        chosen = set(range(len(put))) if whole else hits(put, words, "+" if r.text[m.start() - 1 : m.start()] == "+" else "")
        for i in sorted(chosen):
            a, b, end, x = put[i]
            edits.append((a, end, x) if i + 1 in chosen else (a, b, x.rstrip(" ") if x.strip(".") else x))
    return r.apply(edits)


def without_articles(words: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The words of a run without an article before its first or behind its last number in digits ("... 555-1373 Un
    ..."), if no other digit in the run is spelled."""
    if any(w in SPELLED and w not in ARTICLES for *_, w in words):
        return words
    a, b = 0, len(words)
    while b - a > 1 and words[b - 1][2] in ARTICLES and words[b - 2][2].isdigit():
        b -= 1
    while b - a > 1 and words[a][2] in ARTICLES and words[a + 1][2].isdigit():
        a += 1
    return words[a:b]


def hits(put: list[tuple[int, int, int, str]], words: list[tuple[int, int, str]], sign: str) -> set[int]:
    """The places in a rewritten run that detectors find to be in an identifier together with a
    spelled or disguised one; ``sign`` is what stands before the run."""
    starts, size = [], len(sign)
    for *_, x in put:
        starts.append(size)
        size += len(x)
    chosen: set[int] = set()
    for _, a, b in detect(sign + "".join(x for *_, x in put)):
        within = range(max(0, bisect_right(starts, a) - 1), bisect_right(starts, b - 1))
        if any(not words[i][2].isdigit() for i in within):
            chosen.update(within)
    return chosen


def signs(r: Rewritten) -> Rewritten:
    """At and dot disguises of e-mail addresses to their signs."""
    if DISGUISE_HINT.search(r.text.lower()) is None:
        return r
    r = r.apply([(m.start(), m.end(), ".") for m in IN_LOCAL.finditer(r.text)])
    edits = []
    for m in DISGUISE.finditer(r.text):
        a, b = m.span("at")
        dots = [d.span() for d in DOTS.finditer(r.text, b, m.end())]
        last = r.text[dots[-1][1] : m.end()]
        parts = [r.text[x:y] for x, y in ((a, b), *dots)]
        bracketed = any(c in p for p in parts for c in "[({<")
        spelled_dot = any(p.strip().lower() in DOT_WORDS.split("|") for p in parts[1:])
        # a bare "at" before a plain host name is prose
        sign = parts[0].strip().lower()
        hidden = bracketed or spelled_dot or (sign == "@" and parts[0] != "@") or sign in AT_WORDS.split("|")[1:]
        if not hidden or not (2 <= len(last) <= 24 and last.isalpha()):
            continue
        spaced_dot = any(p.strip() == "." != p for p in parts[1:])
        host = r.text[b : dots[0][0]].lower()
        if (not bracketed or spaced_dot) and (last.lower() not in TOP_LEVEL or host in NO_HOSTS):
            continue
        edits.append((a, b, "@"))
        edits += [(x, y, ".") for x, y in dots if r.text[x:y] != "."]
    return r.apply(edits)


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans with those that only show after rewriting. A base span stays
    beside a wider one of which it is a part; what a base span of its kind covers is not added."""
    base = detect(text)
    r = signs(digits(characters(references(Rewritten(text)))))
    if not r.pieces:
        return base, base
    added = set()
    for kind, a, b in detect(r.text):
        i = bisect_right(r.starts, b - 1) - 1
        if i < 0 or r.pieces[i][1] <= a:
            continue  # no rewritten character in it
        x, y = r.back(a, False), r.back(b, True)
        near = bisect_right(base, (kind, x, len(text))) - 1  # the last of its kind that starts at x or before
        if x < y and not (near >= 0 and base[near][0] == kind and base[near][2] >= y):
            added.add((kind, x, y))
    return base, sorted({*base, *added})


def batches_by_size(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches with about CHARS_AT_ONCE characters, and their texts."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for a, b in slices([x or "" for x in texts]):
            yield batch.slice(a, b - a), texts[a:b]


def detect_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with base_spans and spans: arrays of (kind, start, end) in code points, end exclusive.

    base_spans are plain identifiers, spans also the deobfuscated ones, ordered by kind and start (of
    equal starts the shorter first). Null texts count as empty and have none. Very long texts are
    scanned whole, once a detector. Repeated rows give repeated results; an empty table stays empty;
    columns of these names are replaced.
    """
    df = df.drop("base_spans", "spans")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*df.schema.fields, T.StructField("base_spans", span), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_by_size(batches, text):
            found = [find(x or "") for x in texts]
            columns = [pa.array([named(f[i]) for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of personal data in column ``text`` replaced by its kind in angle
    brackets; of spans that overlap, the union by the kind of the first, the longest of equal starts.
    A null text stays null, an empty one empty; repeated rows stay repeated, an empty table empty."""
    schema = df.schema

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        spans = sorted(((a, b, k) for k, a, b in find(value)[1]), key=lambda s: (s[0], -s[1], s[2]))
        out, done = [], 0
        for a, b, k in spans:
            if a < done:
                done = max(done, b)
                continue
            out += [value[done:a], f"<{KINDS[k]}>"]
            done = b
        return "".join([*out, value[done:]]) if spans else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches_by_size(batches, text):
            columns = list(batch.columns)
            columns[batch.schema.get_field_index(text)] = pa.array([clean(x) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)
