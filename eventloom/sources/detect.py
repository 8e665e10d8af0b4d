"""What a file's first bytes tell: encoding, format, delimiter, quotes, header, damage."""

from __future__ import annotations

import re
from dataclasses import dataclass
from statistics import mean, pvariance

#: Byte order marks and their encodings, the longer first.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
DELIMITERS = (",", "\t", ";", "|", ":")


def encoding(head: bytes) -> str:
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    if all(b < 0x80 for b in head):
        return "ascii"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.reason != "unexpected end of data":  # the sample may end within a character
            return "latin-1"
    return "utf-8"


def text_of(head: bytes) -> str:
    name = encoding(head)
    skip = 2 if name.startswith("utf-16") else 0
    return head[skip:].decode(name, errors="replace")


def format_of(head: bytes, path: str = "") -> str:
    """parquet, gzip, xlsx, xes, xml, json, jsonl, tsv, csv, accesslog or unknown: by content first, then by extension."""
    if head.startswith(b"PAR1"):
        return "parquet"
    if head.startswith(b"\x1f\x8b"):
        return "gzip"
    if head.startswith(b"PK\x03\x04"):
        return "xlsx"
    text = text_of(head).lstrip()
    if text.startswith("<"):
        return "xes" if re.search(r"<log[\s>]", text) else "xml"
    if text[:1] in "[{":
        lines = [x for x in text.splitlines() if x.strip()]
        several = len(lines) > 1 and all(x.strip().startswith("{") and x.strip().endswith("}") for x in lines[:3])
        return "jsonl" if several or (text.startswith("{") and len(lines) == 1) else "json"
    if re.match(r'\S+ \S+ \S+ \[[^\]]+\] "', text):
        return "accesslog"
    first = text.split("\n", 1)[0]
    if first.count("\t") > first.count(","):
        return "tsv"
    if "," in first or ";" in first or "|" in first:
        return "csv"
    return {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "xes": "xes", "xlsx": "xlsx", "log": "accesslog"}.get(path.rsplit(".", 1)[-1].lower(), "unknown")


def outside_quotes(line: str, char: str, quote: str = '"') -> int:
    """How often a character stands outside quotes."""
    return sum(part.count(char) for part in line.split(quote)[::2])


def lines_of(text: str, most: int = 100) -> list[str]:
    return [x for x in re.split(r"\r\n|\n|\r", text) if x][:most]


def delimiter(text: str) -> str:
    """The delimiter whose number per line varies least against its mean (at least 1)."""
    lines = lines_of(text)

    def spread(d: str) -> float:
        counts = [outside_quotes(x, d) for x in lines]
        middle = mean(counts) if counts else 0
        return pvariance(counts) / middle if middle >= 1 else float("inf")

    best = min(DELIMITERS, key=lambda d: (spread(d), DELIMITERS.index(d)))
    return best if spread(best) < float("inf") else ","


def quote_char(text: str) -> str:
    return "'" if text.count("'") > text.count('"') and text.count('"') == 0 else '"'


def line_ending(text: str) -> str:
    crlf = text.count("\r\n")
    return "\r\n" if crlf and crlf >= text.count("\n") - crlf else "\n" if "\n" in text else "\r" if "\r" in text else "\n"


def fields(line: str, delim: str) -> list[str]:
    out, now, quoted = [], "", False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        elif ch == delim and not quoted:
            out.append(now)
            now = ""
            continue
        now += ch
    return [x.strip().strip('"') for x in [*out, now]]


def _numeric(x: str) -> bool:
    return bool(re.fullmatch(r"[+-]?\d+(\.\d+)?", x))


def has_header(text: str, delim: str | None = None) -> bool:
    """Names in the first row: none numeric and all different, and the second row more numeric or names like identifiers."""
    rows = [fields(x, delim or delimiter(text)) for x in lines_of(text, 2)]
    if not rows or any(map(_numeric, rows[0])) or len(set(rows[0])) < len(rows[0]) or "" in rows[0]:
        return False
    named = sum(bool(re.fullmatch(r"[A-Za-z_][\w:. -]*", x)) for x in rows[0]) == len(rows[0])
    return named if len(rows) == 1 else sum(map(_numeric, rows[1])) > 0 or named


def embedded_newlines(text: str) -> bool:
    return any(x.count('"') % 2 for x in lines_of(text)) and text.count('"') % 2 == 0


def odd_quotes(text: str) -> bool:
    return text.count('"') % 2 == 1


def ragged(text: str, delim: str) -> bool:
    counts = [outside_quotes(x, delim) for x in lines_of(text)]
    return bool(counts) and sum(c != counts[0] for c in counts) > 0.05 * len(counts)


def date_order(values: list[str]) -> str:
    """DMY, MDY or YMD by the parts over 12 of dates like 03/04/2024; YMD where the year leads."""
    first = second = 0
    for v in values:
        if re.match(r"\d{4}[-/.]", v):
            return "YMD"
        if m := re.match(r"(\d{1,2})[-/.](\d{1,2})[-/.]\d{2,4}", v):
            first += int(m[1]) > 12
            second += int(m[2]) > 12
    return "DMY" if first >= second and first else "MDY" if second else "YMD" if not values else "DMY"


@dataclass(frozen=True)
class Analysis:
    format: str
    encoding: str
    delimiter: str
    quote: str
    line_ending: str
    header: bool
    columns: int
    embedded_newlines: bool
    odd_quotes: bool
    ragged: bool
    null_tokens: bool
    strategy: str


def analyse(head: bytes, path: str = "") -> Analysis:
    """Everything about a file from its head; `strategy` is robust for damaged delimited text, else fast."""
    from eventloom.operators.quality import NULL_TOKENS

    text, kind = text_of(head), format_of(head, path)
    delim = "\t" if kind == "tsv" else delimiter(text)
    damaged = kind in ("csv", "tsv") and (odd_quotes(text) or ragged(text, delim) or encoding(head) == "latin-1")
    cells = [c for x in lines_of(text, 20) for c in fields(x, delim)] if kind in ("csv", "tsv") else []
    first = lines_of(text, 1)
    return Analysis(kind, encoding(head), delim, quote_char(text), line_ending(text), has_header(text, delim), len(fields(first[0], delim)) if first else 0, embedded_newlines(text), odd_quotes(text), ragged(text, delim), any(c in NULL_TOKENS for c in cells), "robust" if damaged else "fast")
