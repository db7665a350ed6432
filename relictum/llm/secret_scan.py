"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only at its hits, embedded checksums decide.

Kinds, in the order of the result: assign, access, hex, then github and npm, which carry a CRC-32 of their own body.
Hexadecimal runs have no keyword; every eighth byte is probed instead, and a pattern runs where four probes in a row fall
on hexadecimal digits, as they do in each run of 32.

Defined cases: null and empty texts have no spans; long texts are scanned whole; spans count code points; repeated rows
each get their spans; columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import text_udf

KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SPANS = "array<struct<kind:string,start:long,end:long>>"
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def base62(value: int, width: int) -> bytes:
    out = bytearray()
    for _ in range(width):
        value, digit = divmod(value, 62)
        out.append(DIGITS[digit])
    return bytes(out[::-1])


def checksum_holds(body: bytes, check: bytes) -> bool:
    return base62(zlib.crc32(body), 6) == check


def keywords():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        automaton.add_word(word, (0, len(word)))
    automaton.add_word("akia", (1, 4))
    for prefix in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        automaton.add_word(prefix, (3, 4))
    automaton.add_word("npm_", (4, 4))
    automaton.make_automaton()
    return automaton


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Maximal runs of 32 and more hexadecimal digits."""
    probe = IS_HEX[np.frombuffer(data, np.uint8)[::8]]
    if len(probe) < 4:
        return []
    runs, end = [], 0
    for at in np.flatnonzero(probe[:-3] & probe[1:-2] & probe[2:-1] & probe[3:]) * 8:
        if at < end:
            continue
        begin = int(at)
        while begin > end and IS_HEX[data[begin - 1]]:
            begin -= 1
        end = HEX.match(data, begin).end()
        if end - begin >= 32:
            runs.append((begin, end))
    return runs


def secret_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) in code points, in order."""
    data = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in automaton.iter(data.lower().decode("latin-1")))
    past = [0] * len(KINDS)
    for start, kind in hits:
        if start < past[kind]:
            continue
        if kind == 0 and (m := ASSIGN.match(data, start)):
            past[0] = m.end()
            if len(m[2]) >= 8:
                found.append((start, 0, m.end()))
        elif kind == 1 and (m := ACCESS.match(data, start)):
            past[1] = m.end()
            if m.end() - start >= 16:
                found.append((start, 1, m.end()))
        elif kind > 2 and (m := CHECKED[KINDS[kind]].match(data, start)) and checksum_holds(m[1], m[2]):
            past[kind] = m.end()
            found.append((start, kind, m.end()))
    found += [(a, 2, b) for a, b in hex_runs(data)]
    if found and len(data) != len(text):
        at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points begun up to each byte
        point = lambda x: int(at[x - 1]) if x else 0
        found = [(point(a), k, point(b)) for a, k, b in found]
    return sorted(found)


def find_spans(texts: list[str]) -> pa.Array:
    automaton = keywords()
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in secret_spans(x, automaton)] for x in texts], SPANS_ARROW)


def redacted(texts: list[str], mark: str = "[SECRET]") -> pa.Array:
    automaton, out = keywords(), []
    for text in texts:
        parts, at = [], 0
        for start, _, end in secret_spans(text, automaton):
            if start >= at:
                parts += [text[at:start], mark]
            at = max(at, end)
        out.append("".join([*parts, text[at:]]) if parts else text)
    return pa.array(out, pa.string())


def scan_secrets(docs: DataFrame, *, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """`docs` with an array of spans (kind, start, end) of every whole text; overlapping kinds are all listed."""
    return docs.withColumn(spans_col, text_udf(find_spans, SPANS)(F.col(text_col)))


def redact_secrets(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """`docs` with each maximal stretch of spans replaced by a mark; texts without a span stay as they are, null stays null."""
    clean = text_udf(redacted, "string")(F.col(text_col))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean))


def joined_spans(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
