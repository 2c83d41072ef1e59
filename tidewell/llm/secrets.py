"""Secret scan by assignment-aware lexing.

A text is lexed into assignments of configuration and source syntax: a name (bare, dotted or quoted), an operator
(`=`, `:`, `:=`, `=>`, `+=`, also after a type) and a value. A value's terms are quoted strings (prefixed and triple-quoted
ones too), bare words and names, joined by `+`, by standing next to each other, by brackets or by a continued line; or the
lines of an indented block value. What is called or indexed is no literal.

Names bound to values are propagated into later values, or earlier ones where a name is only bound later on. A value built
of several terms is scored as the one literal that it makes, and all its pieces are reported where they are written. The
score adds up the sensitivity of the target name (by whole parts of it) and the shape of the literal. Beside that stand
three plain patterns (assign, access, hex), which are always reported.

Cases: a null text counts as empty and has no spans. Matches of one pattern never overlap; among kinds they may.
Spans that the lexer finds inside a plain span are not repeated. Names bound in a circle count as unbound where the
circle closes. Very long texts, names and chains of constants are dealt with in linear time, whole. Rows are independent: repeated
rows, ties, empty tables and extra columns need no rule. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, pick

# Fixed patterns of the plain kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "lexed")

#: What parts of a name, or neighbouring parts together, bind a secret, with its weight. The longer ones may also end a part (`dbpassword`).
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 1.0, "secretkey": 1.0, "token": 0.8, "authtoken": 1.0, "accesstoken": 1.0, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.8, "credentials": 0.8, "bearer": 0.7, "signingkey": 1.0, "connectionstring": 0.7, "auth": 0.5}
LONGEST = max(map(len, SENSITIVE))
ENDINGS = tuple(s for s in SENSITIVE if len(s) >= 8 or s in ("passwd", "apikey"))
#: Parts that end the name of something about a secret, not of one.
ABOUT = frozenset("age count dir field file format header help hint label len length limit max message min name path policy prefix prompt regex size title type url".split())
#: Words that stand for a value to be filled in.
FILLERS = frozenset("changeme dummy example false none null placeholder redacted sample todo true undefined your".split())
LEAST = 1.5
#: Characters up to which a joined value is looked at as a placeholder: longer ones are none.
PLACEHOLDER = 4096

NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
HEAD = re.compile(rf"""(?<![A-Za-z0-9_.])(?<![A-Za-z0-9_.]-)(?:(?P<name>{NAME})|"(?P<dq>{NAME})"|'(?P<sq>{NAME})')[ \t]*+(?P<op>:=|=>|\+=|=(?![=>])|:(?![:=/]))""")
STRING = re.compile(r"""[A-Za-z]{0,2}(?:\"\"\"(?P<a>(?:[^\\]|\\.)*?)\"\"\"|'''(?P<b>(?:[^\\]|\\.)*?)'''|\"(?P<c>(?:[^\"\\\n]|\\.)*+)\"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`\n]*+)`)""", re.S)
BARE = re.compile(r"[A-Za-z0-9+/_.=@:$%^!~*-]+")
TYPE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]\n]*\])?[ \t]*+=(?![=>])")
BLOCK = re.compile(r"[ \t]*[|>][0-9+-]*[ \t]*\r?\n")
PLAIN_NAME = re.compile(NAME)
GAP, WIDE_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*"), re.compile(r"(?:\s|\\\r?\n)*")
JOIN = re.compile(r"\+(?![=+])|\.\.(?!\.)|\.(?=[ \t])")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
WORDS = re.compile(r"[A-Za-z]+")
#: Whatever sensitivity() is above 0 for meets this: the same entries, with what may stand between letters of a name.
LOOKS_LIKE = re.compile("|".join("[_.-]*".join(s) for s in SENSITIVE if not any(o != s and o in s for o in SENSITIVE)), re.I | re.A)
MARK = re.compile(r"[=:]")

Span = tuple[int, int]


@lru_cache(1 << 14)
def sensitivity(name: str) -> float:
    """Weight of the heaviest entry that the name's parts make; parts end at punctuation, digits and changes of case."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[-1] in ABOUT or parts[0] in ("max", "min", "num"):
        return 0.0
    best = 0.0
    for i, p in enumerate(parts):
        run = ""
        for q in parts[i : i + LONGEST]:
            run += q
            best = max(best, SENSITIVE.get(run, 0.0))
        best = max([best, *(SENSITIVE[e] for e in ENDINGS if p.endswith(e))])
    return best


def entropy(counts: Counter) -> float:
    """Bits a character."""
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


def filler(literal: str) -> bool:
    """Whether a value is one to be filled in: a reference, one character over and over, or filler words with little beside them."""
    if re.fullmatch(r"<.*>|\$?\{.*\}|%\(.*\)s|\$[A-Za-z_]\w*|\[.*\]", literal, re.S) or len(set(literal.lower())) < 3:
        return True
    words = [w.lower() for w in WORDS.findall(literal)]
    if not any(w in FILLERS or not w.strip("x") and len(w) > 2 for w in words):
        return False
    rest = WORDS.sub(lambda m: "" if m.group().lower() in FILLERS or not m.group().lower().strip("x") else m.group(), literal)
    return not any(len(r) >= 6 and re.search("[0-9]", r) for r in re.findall("[A-Za-z0-9]+", rest))


class Value:
    """What a name is bound to: own pieces, and values it is built of, in order; with the counts of its characters, and the whole of it where that is short."""

    __slots__ = ("parts", "counts", "whole", "quoted", "told")

    def __init__(self):
        self.parts: list = []
        self.counts: Counter | None = None
        self.whole: str | None = None
        self.quoted = self.told = False


def score(name: str, counts: Counter, whole: str | None) -> float:
    """0 to 3: sensitivity of the name, plus length and variety of the literal; 0 for placeholders and prose. The whole literal is given where it is short."""
    weight, n = sensitivity(name), sum(counts.values())
    if not weight or n < 6 or (whole is not None and filler(whole)):
        return 0.0
    lower, upper, digit = any("a" <= c <= "z" for c in counts), any("A" <= c <= "Z" for c in counts), any("0" <= c <= "9" for c in counts)
    other = any(not (c.isascii() and c.isalnum()) for c in counts)
    if counts[" "] and not digit and "passphrase" not in name.lower().replace("_", ""):
        return 0.0
    return weight + min(1.0, entropy(counts) / 4) * 0.75 + 0.25 * (lower + upper + digit + other - 1) + (0.25 if n >= 16 else 0.0)


def block_lines(text: str, head: int, at: int) -> tuple[list[Span], int]:
    """Lines of an indented block value, without their indentation, and where it ends."""
    line = text.rfind("\n", 0, head) + 1
    indent = len(text[line:head]) - len(text[line:head].lstrip(" \t-"))
    out = []
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        row = text[at:stop]
        body = row.strip()
        if body:
            lead = len(row) - len(row.lstrip(" \t"))
            if lead <= indent:
                break
            out.append((at + lead, at + lead + len(body)))
        at = stop + 1
    return out, min(at, len(text))


def terms(text: str, at: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """Terms of a value (kind `string`, `bare` or `other`, start, end), where it ends, and where to read on: in a string of several lines, at its beginning."""
    out, depth, gap, resume = [], 0, GAP, -1
    at = gap.match(text, at).end()
    while at < len(text) and text[at] in "([":
        depth, gap = depth + 1, WIDE_GAP
        at = gap.match(text, at + 1).end()
    while at < len(text):
        if m := STRING.match(text, at):
            kind = m.lastgroup
            out.append(("string", m.start(kind), m.end(kind)))
            if kind in "ab" and resume < 0:
                resume = m.start(kind)
            at = m.end()
        elif m := BARE.match(text, at):
            start, end = m.span()
            joins = end < len(text) and text[end] in "\"'`" and text[end - 1] == "+"
            if text[end : end + 1] in ("(", "["):
                out.append(("other", start, end))
                return out, end, end if resume < 0 else resume
            end -= joins
            if end > start:
                out.append(("bare", start, end))
            at = end
        else:
            break
        after = gap.match(text, at).end()
        if m := JOIN.match(text, after):
            at = WIDE_GAP.match(text, m.end()).end()
        elif out[-1][0] == "string" and STRING.match(text, after):
            at = after
        elif depth and text[after : after + 1] == ",":
            at = WIDE_GAP.match(text, after + 1).end()
            out.append(("next", at, at))
        else:
            break
    return out, at, at if resume < 0 else resume


def lex(text: str) -> list[tuple[str, str, list[tuple[str, int, int]]]]:
    """Assignments in order: name, operator, terms of the value (`next` parts the members of a list)."""
    out, at = [], 0
    while m := HEAD.search(text, at):
        name = m.group("name") or m.group("dq") or m.group("sq")
        op, start = m.group("op"), m.end()
        if op == ":":
            if b := BLOCK.match(text, start):
                lines, _ = block_lines(text, m.start(), b.end())
                out.append((name, op, [("string", s, e) for s, e in lines]))
                at = b.end()  # what the block says is lexed as well
                continue
            if t := TYPE.match(text, GAP.match(text, start).end()):
                start = t.end()
        found, _, at = terms(text, start)
        at = max(at, m.end())
        out.append((name, op, found))
    return out


def values_of(text: str) -> list[tuple[str, Value]]:
    """Each assignment's name and value, with names in values resolved: to the last binding before, else the first one after."""
    bindings = lex(text)
    places: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(bindings):
        places.setdefault(name, []).append(i)
    values = [Value() for _ in bindings]

    def bound(name: str, i: int) -> Value | None:
        if not (at := places.get(name)):
            return None
        k = bisect_right(at, i - 1)
        j = at[k - 1] if k else next((x for x in at if x > i), -1)
        return values[j] if j >= 0 else None

    out = []
    for i, (name, op, found) in enumerate(bindings):
        value, members = values[i], []
        if op == "+=" and (old := bound(name, i)) is not None:
            value.parts.append(old)
        here = value
        for kind, start, end in found:
            if kind == "next":
                here = Value()
                members.append(here)
            elif kind == "string":
                here.parts.append((start, end))
                here.quoted = True
            elif kind == "bare":
                if len(found) > 1 and PLAIN_NAME.fullmatch(text[start:end]) and not re.search(r"\d", text[start:end]) and bound(text[start:end], i) is None:
                    continue  # a name bound nowhere
                pieces, at = [], start
                for word in text[start:end].split("+"):
                    pieces.append((word, at, at + len(word)))
                    at += len(word) + 1
                known = [bound(w, i) if PLAIN_NAME.fullmatch(w) else None for w, _, _ in pieces]
                if all(k is not None for k in known):
                    here.parts += known
                elif (one := bound(text[start:end], i) if PLAIN_NAME.fullmatch(text[start:end]) else None) is not None:
                    here.parts.append(one)
                else:
                    here.parts.append((start, end))
        out.append((name, value))
        out += [(name, v) for v in members]
    return out


def weigh(text: str, values: list[Value]) -> None:
    """Counts of characters of every value, parts before wholes. A value inside itself counts for nothing there."""
    busy: set[int] = set()
    for first in values:
        open_ = [(first, False)]
        while open_:
            v, ready = open_.pop()
            if v.counts is not None:
                continue
            if ready:
                kept, sums, wholes = [], [], []
                for p in v.parts:
                    if isinstance(p, tuple):
                        if p[1] > p[0]:
                            kept.append(p)
                            sums.append(Counter(text[p[0] : p[1]]))
                            wholes.append(text[p[0] : p[1]] if p[1] - p[0] <= PLACEHOLDER else None)
                    elif p.counts:  # neither empty nor the value itself
                        kept.append(p)
                        sums.append(p.counts)
                        wholes.append(p.whole)
                        v.quoted |= p.quoted
                v.parts, v.counts = kept, sums[0] if len(sums) == 1 else Counter()
                if len(sums) > 1:
                    for x in sums:
                        v.counts.update(x)
                if None not in wholes and sum(map(len, wholes)) <= PLACEHOLDER:
                    v.whole = "".join(wholes)
                busy.discard(id(v))
            elif id(v) not in busy:
                busy.add(id(v))
                open_.append((v, True))
                open_ += [(p, False) for p in v.parts if not isinstance(p, tuple) and p.counts is None and id(p) not in busy]


def lexed_spans(text: str) -> list[Span]:
    """Places of literals that reach a sensitive name, straight or through constants."""
    if not MARK.search(text) or not LOOKS_LIKE.search(text):
        return []
    bound = values_of(text)
    if not any(sensitivity(n) for n, _ in bound):
        return []
    weigh(text, [v for _, v in bound])
    found: set[Span] = set()
    for name, value in bound:
        if value.told or not sensitivity(name):
            continue
        counts = value.counts
        if not value.quoted and not any("0" <= c <= "9" for c in counts):
            continue
        if score(name, counts, value.whole) < LEAST:
            continue
        open_ = [value]
        while open_:
            v = open_.pop()
            if isinstance(v, tuple):
                if v[1] > v[0]:
                    found.add(v)
            elif not v.told:
                v.told = True
                open_ += v.parts
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Plain spans and all spans, by start and then kind."""
    plain = []
    if MARK.search(text):
        plain += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        plain += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    plain += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    plain.sort(key=order)
    more, k, until = [], 0, -1
    for s, e in lexed_spans(text):
        while k < len(plain) and plain[k][0] <= s:
            until, k = max(until, plain[k][1]), k + 1
        if e > until:
            more.append((s, e, "lexed"))
    return plain, sorted(plain + more, key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, end, kind in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])


SCHEMA = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "masked": "string"}


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(SCHEMA), carry: tuple[str, ...] = ()) -> DataFrame:
    """Spans of secrets in each whole text: id_col, those of `outputs` asked for, and the columns of `carry`; `masked` is the text with the spans replaced (null stays null)."""
    docs = pick(docs, id_col, text_col, *[c for c in carry if c not in (id_col, text_col)])
    own = [f for f in docs.schema.fields if f.name == id_col or f.name in carry]
    at = [docs.columns.index(f.name) for f in own]
    arrow = {"long": pa.int64(), "string": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {k: [] for k in SCHEMA}
        for text in batch.column(1).to_pylist():
            plain, spans = scan(text or "")
            n = Counter(k for _, _, k in plain)
            for kind in KINDS[:3]:
                rows[f"n_{kind}"].append(n[kind])
            rows["base_sha256"].append(hashlib.sha256(joined(plain).encode()).hexdigest())
            rows["spans"].append(joined(spans))
            rows["masked"].append(text if text is None or not spans or "masked" not in outputs else masked(text, spans))
        return pa.RecordBatch.from_arrays([batch.column(i) for i in at] + [pa.array(rows[k], arrow[SCHEMA[k]]) for k in outputs], names=[f"c{i}" for i in at] + list(outputs))

    out = map_arrow(docs, run, ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in zip(at, own)] + [f"{k} {SCHEMA[k]}" for k in outputs]))
    return out.toDF(*[f.name for f in own], *outputs)
