"""Secret scan: fixed patterns, and assignment-aware lexing that follows constants to sensitive names."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex", "literal")
#: fixed values: the three patterns, and how long a match (of assign: its second group) must be
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# a run of at least that length is found at the same places as the run itself, and faster
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

#: name, then an assignment sign, then the rest of the expression up to the end of the statement
_BINDING = re.compile(r"""
    (?P<name> ["']? [A-Za-z_][A-Za-z0-9_.\-]{0,80} (?: \[ ["'] [A-Za-z0-9_.\-]{1,80} ["'] \] )? ["']? )
    [\x20\t]* (?: :=|=>|=(?!=)|: ) [\x20\t]* (?= [^\s:=] )""", re.X | re.A)
_PART = re.compile(r"""
    "(?P<double>(?:[^"\\\n]|\\.)*)" | '(?P<single>(?:[^'\\\n]|\\.)*)' | \$\{?(?P<ref>[A-Za-z_][A-Za-z0-9_]*)\}? |
    (?P<call>[A-Za-z_][A-Za-z0-9_.]*)\( | (?P<bare>[A-Za-z0-9_+/.=\-]+)""", re.X | re.A)
_BETWEEN = re.compile(r"[\x20\t]*(?:\+|\.|\|\|)?[\x20\t]*(?:\\?\n[\x20\t]*)?", re.A)
#: what may stand before a name that begins a line of configuration, and before a comment that ends one
_HEAD = re.compile(r"[\x20\t]*(?:-[\x20\t]+)?(?:(?:export|set|env|arg|declare|local)[\x20\t]+(?:-\w+[\x20\t]+)?)?", re.I | re.A)
_COMMENT = re.compile(r"[\x20\t]+(?:\#|;|//)")
_WORD, _SPOKEN = re.compile(r"\S+"), re.compile(r"""[^=+(){}\[\]"'?|\\]*""")
#: values that are code: plain names with a mark before them or joined, an attribute with a mark after it, or a name before a bracket
_NAMES = re.compile(r"[*&!-]?[A-Za-z_]+(?:(?:\.|->|::|\?\.|\|)[A-Za-z_]+)*[;,]*|[A-Za-z_]\w*(?:\??\.\w+)+!?[;,]*", re.A)
_OPENED = re.compile(r"[*&!-]?[A-Za-z_$][\w$]*(?:(?:\.|->|::|\?\.)[\w$]+)*[(\[<]", re.A)
#: scores by what a target's name says; a name's pieces are cut at case changes and at _ - .
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "credential": 3, "credentials": 3,
             "auth": 2, "bearer": 2, "private": 2, "key": 1, "access": 1, "api": 1, "client": 1, "session": 1, "signature": 1, "salt": 1, "dsn": 2, "cert": 1}
HARMLESS = {"public": -2, "max": -2, "min": -2, "count": -2, "length": -2, "len": -2, "name": -1, "file": -1, "path": -1, "url": -1, "type": -1, "id": -1, "primary": -2, "foreign": -2, "field": -2, "label": -2}
PLACEHOLDERS = frozenset("null none true false undefined changeme example placeholder password secret token todo xxx xxxx test".split())
FLAG_AT = 4.0


def name_score(name: str) -> float:
    pieces = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)
    low = [p.lower() for p in pieces]
    joined = low + ["".join(low[k:k + 2]) for k in range(len(low) - 1)]
    return sum(SENSITIVE.get(p, 0) + HARMLESS.get(p, 0) for p in set(joined))


def literal_score(value: str) -> float:
    """0 to 3: longer values of mixed, evenly used characters are likelier secrets."""
    if len(value) < 6 or value.lower() in PLACEHOLDERS or len(set(value)) < 4 or " " in value.strip():
        return -9.0
    counts = Counter(value)
    entropy = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(entropy, 4.5) / 2.25 + (kinds > 2) * 0.5 + (len(value) >= 20) * 0.5


def is_code(value: str) -> bool:
    if _NAMES.fullmatch(value):
        return True
    return bool(_OPENED.match(value)) and (value[-1] in "([{<," or all(value.count(a) == value.count(b) for a, b in ("()", "[]", "<>")))


def config_value(text: str, at: int, sign: str) -> tuple[str, str, int, int] | None:
    """The unquoted value of a line of configuration from ``at``, after ``sign``, to the line's end, less a trailing
    comment; None for code.

    Values that begin with a quote, ``$`` or a bracket, calls, subscripts and joined plain names are code. One with
    blanks is scored by its first word and spans all of it, if no operator, quote or bracket follows.
    """
    stop = text.find("\n", at)
    raw = text[at:len(text) if stop < 0 else stop].rstrip()
    if raw[0] == "#" and text[at - 1] in " \t" and (raw[1:2] in ("", " ", "\t") or sign.rstrip()[-1] == ":"):
        return None  # a comment in place of a value
    if comment := _COMMENT.search(raw):
        raw = raw[:comment.start()]
    word = _WORD.match(raw).group()
    if raw[0] in "\"'$({[<" or is_code(word) and not re.fullmatch(r"[A-Za-z0-9_]+", word) or is_code(raw) and raw != word:
        return None
    bare = _PART.match(raw)
    plain = bare is not None and bare["bare"] is not None and not word[bare.end():].strip(";,)]}")
    value = bare["bare"] if plain else word
    if word == raw:
        return None if plain else ("config", value, at, at + len(raw))
    if word[0] in "!&*" or not _SPOKEN.fullmatch(raw, len(word)):
        return None if plain or word[0] in "!&*" else ("config", value, at, at + len(word))
    return ("bare" if plain else "config", value, at, at + len(raw))


def lex(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """Name and parts of each assignment: ``("text", value, start, end)`` for a literal, ``("name", name, start, end)``
    for a reference. Parts joined by ``+ . ||`` or a continued line belong together. Quoted names (JSON, maps),
    ``export``, ``:=``, ``=>``, ``name["key"]`` and bare values (dotenv, YAML, INI; see ``config_value``) are read."""
    at = seen = line = 0
    while hit := _BINDING.search(text, at):
        name = hit["name"].strip("\"'")
        if "[" in name:
            name = name.split("[")[1].strip("]\"'")
        line, seen = max(line, text.rfind("\n", seen, hit.start()) + 1), hit.start()
        at, parts = hit.end(), []
        if _HEAD.fullmatch(text, line, hit.start()) and (whole := config_value(text, at, hit.group())):
            yield name, [whole]
            at = whole[3]
            continue
        while part := _PART.match(text, at):
            at = part.end()
            if part["double"] is not None or part["single"] is not None:
                parts.append(("text", part["double"] if part["double"] is not None else part["single"], part.start() + 1, part.end() - 1))
            elif part["ref"]:
                parts.append(("name", part["ref"], part.start("ref"), part.end("ref")))
            elif part["call"]:
                continue  # its arguments are parts: getenv("X"), b64decode("...")
            else:
                parts.append(("bare", part["bare"], part.start(), part.end()))
            glue = _BETWEEN.match(text, at)
            if not re.search(r"[+.|\n]", glue.group()) or ("\n" in glue.group() and not re.search(r"[+.|\\]", glue.group())):
                break
            at = glue.end()
        yield name, parts
        at = max(at, hit.end())


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants named earlier or later in the text.

    A reference takes the latest value before it, as when the text runs. If there is none, the last of all later values
    takes part in the whole expression and each other one counts by itself. Followed until nothing changes.
    """
    if "=" not in text and ":" not in text:
        return []
    values: dict[str, list[int]] = {}
    bindings = []
    for name, parts in lex(text):
        if parts:
            values.setdefault(name.rsplit(".", 1)[-1], []).append(len(bindings))
            bindings.append((name, parts))
    found, done = set(), set()
    for first, (name, _) in enumerate(bindings):
        score = name_score(name)
        if score < 1:
            continue
        starts = [first]
        while starts:
            start = starts.pop()
            if (start, score) in done:
                continue
            done.add((start, score))
            literals, seen, queue = [], {start}, [start]
            while queue:
                use = queue.pop()
                for kind, value, lo, hi in bindings[use][1]:
                    bound = value.rsplit(".", 1)[-1] if kind == "bare" else value
                    if kind in ("bare", "name") and bound in values:
                        places = values[bound]
                        k = bisect_left(places, use)
                        takes = places[k - 1] if k else places[-1]
                        if not k and (bound, score) not in done:
                            done.add((bound, score))
                            starts += places[:-1]
                        if takes not in seen:
                            seen.add(takes)
                            queue.append(takes)
                    elif kind != "name":
                        literals.append((lo, hi, value))
            whole = "".join(v for _, _, v in sorted(literals))
            if score + literal_score(whole) >= FLAG_AT:
                found.update((lo, hi) for lo, hi, v in literals if v)
    return sorted(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind number, end`` of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_assign, n_access, n_hex, n_literal, base_spans, spans`` of every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then by kind. ``literal`` spans come from
    name-literal pairs whose name and value together score ``FLAG_AT`` or more. A null or empty text has none. Null and
    repeated ids pass through; further columns are not read; nothing is shuffled; every text is read whole.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("_text"):
                text = value.as_py() or ""
                base = base_spans(text)
                more = [(lo, 3, hi) for lo, hi in literal_spans(text)]
                count = Counter(k for _, k, _ in base)
                out.append((count[0], count[1], count[2], len(more), listed(base), listed(sorted(base + more))))
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["_id", "n_assign", "n_access", "n_hex", "n_literal", "base_spans", "spans"])

    return rows.mapInArrow(run, f"_id {kind}, n_assign long, n_access long, n_hex long, n_literal long, base_spans string, spans string").withColumnRenamed("_id", id_col)

