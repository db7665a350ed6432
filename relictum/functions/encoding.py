"""Character encodings of bodies: what they declare, what was chosen, how well it fits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from relictum.functions.url import bound

REPLACEMENT = "�"
REPLACEMENT_THRESHOLD = 0.01
ERA_DEFAULT = "windows-1252"
PRESCAN = 1024
# Labels and what they stand for, and byte signatures of binary formats.
LABELS = {
    "utf8": "utf-8", "utf-8": "utf-8", "unicode-1-1-utf-8": "utf-8",
    "iso-8859-1": "iso-8859-1", "iso8859-1": "iso-8859-1", "iso_8859-1": "iso-8859-1", "latin1": "iso-8859-1", "latin-1": "iso-8859-1", "l1": "iso-8859-1",
    "us-ascii": "us-ascii", "ascii": "us-ascii", "ansi_x3.4-1968": "us-ascii",
    "cp1252": "windows-1252", "windows-1252": "windows-1252",
    "x-sjis": "shift_jis", "sjis": "shift_jis", "shift-jis": "shift_jis", "shift_jis": "shift_jis", "ms_kanji": "shift_jis",
    "euc-kr": "euc-kr", "ks_c_5601-1987": "euc-kr",
}
SIGNATURES = (("PNG", "89504e470d0a1a0a"), ("GIF", "47494638"), ("JPEG", "ffd8ff"), ("ZIP", "504b0304"), ("GZIP", "1f8b"), ("PDF", "255044462d"), ("OLE compound document", "d0cf11e0"), ("Java class", "cafebabe"))
MARKS = (("utf-8", "efbbbf"), ("utf-16le", "fffe"), ("utf-16be", "feff"))
CANDIDATES = ("shift_jis", "euc-kr")
#: What windows-1252 has in place of the controls from 0x80 to 0x9F; its five free bytes stay controls.
WESTERN = "".join(bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0))
# The encodings that pages may declare, with the codec that reads each here. Any other label is unknown, however
# many codecs Python has besides.
CODECS = {
    "utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "ibm866": "cp866",
    "iso-8859-1": "latin-1", "us-ascii": "latin-1",
    "iso-8859-2": "iso8859-2", "iso-8859-3": "iso8859-3", "iso-8859-4": "iso8859-4", "iso-8859-5": "iso8859-5", "iso-8859-6": "iso8859-6",
    "iso-8859-7": "iso8859-7", "iso-8859-8": "iso8859-8", "iso-8859-9": "cp1254", "iso-8859-10": "iso8859-10", "iso-8859-11": "cp874",
    "iso-8859-13": "iso8859-13", "iso-8859-14": "iso8859-14", "iso-8859-15": "iso8859-15", "iso-8859-16": "iso8859-16",
    "koi8-r": "koi8-r", "koi8-u": "koi8-u", "macintosh": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "windows-874": "cp874",
    "windows-1250": "cp1250", "windows-1251": "cp1251", "windows-1252": "cp1252", "windows-1253": "cp1253", "windows-1254": "cp1254",
    "windows-1255": "cp1255", "windows-1256": "cp1256", "windows-1257": "cp1257", "windows-1258": "cp1258",
    "gbk": "gbk", "gb18030": "gb18030", "big5": "big5hkscs", "euc-jp": "euc-jp", "iso-2022-jp": "iso2022-jp", "shift_jis": "shift_jis", "euc-kr": "cp949",
}
SHORT_NAMES = {"utf-16": "utf-16le", "gb2312": "gbk", "x-gbk": "gbk", "cp866": "ibm866", "866": "ibm866", "koi8": "koi8-r", "koi": "koi8-r", "koi8-ru": "koi8-u", "mac": "macintosh", "x-mac-roman": "macintosh", "tis-620": "windows-874", "big5-hkscs": "big5", "cn-big5": "big5", "x-x-big5": "big5", "x-euc-jp": "euc-jp", "windows-31j": "shift_jis", "windows-949": "euc-kr", "korean": "euc-kr", "ksc5601": "euc-kr", "dos-874": "windows-874", "logical": "iso-8859-8", "iso-8859-8-i": "iso-8859-8"}


def codec_of(label: str) -> str | None:
    """The codec of a lower-case label; None for one that no page may declare. Labels of the numbered families are told by rule."""
    name = SHORT_NAMES.get(label, label)
    name = re.sub(r"\A(?:cp|x-cp)(125\d)\Z", r"windows-\1", name)
    name = re.sub(r"\A(?:cs)?iso[-_]?8859[-_]?(\d{1,2})(?::\d{4})?(?:-[ei])?\Z", r"iso-8859-\1", name)
    return CODECS.get(name)


def normal_label(raw: Column) -> Column:
    plain = F.lower(F.regexp_replace(F.trim(raw), r"""^["']|["']$""", ""))
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.when(plain != "", F.coalesce(F.try_element_at(known, plain), plain))


def header_charset(content_type: Column) -> Column:
    pattern = r"""(?i);\s*charset\s*=\s*("[^"]*"|'[^']*'|[^;\s]+)"""
    return F.when(content_type.rlike(pattern), normal_label(F.regexp_extract(content_type, pattern, 1)))


def meta_charset(window: Column) -> Column:
    """(label, source) of the first declaration in the first bytes of a page, given as Latin-1 text."""
    value = r"""("[^"]*"|'[^']*'|[^\s>]+)"""

    def read(tag: Column) -> Column:
        equiv = tag.rlike(rf"(?i)http-equiv\s*=\s*{value}") & F.regexp_extract(tag, rf"(?i)http-equiv\s*=\s*{value}", 1).rlike("(?i)content-type")
        content = F.regexp_replace(F.regexp_extract(tag, rf"(?i)content\s*=\s*{value}", 1), r"""^["']|["']$""", "")
        short = rf"(?i)\bcharset\s*=\s*{value}"
        label = F.when(equiv, header_charset(content)).when(tag.rlike(short), normal_label(F.regexp_extract(tag, short, 1)))
        return F.struct(label.alias("label"), F.when(equiv, "meta-http-equiv").otherwise("meta-charset").alias("source"))

    tags = F.regexp_extract_all(window, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))
    return F.get(F.filter(F.transform(tags, read), lambda x: x["label"].isNotNull()), 0)


def byte_mark(body: Column) -> Column:
    return F.coalesce(*[F.when(F.startswith(body, F.unhex(F.lit(mark))), F.lit(name)) for name, mark in MARKS])


def binary_reason(body: Column) -> Column:
    """A known signature, else the offset of a NUL byte in the first bytes; null for text."""
    signed = [F.when(F.startswith(body, F.unhex(F.lit(mark))), F.lit(f"{name} signature")) for name, mark in SIGNATURES]
    nul = F.position(F.unhex(F.lit("00")), F.substring(body, 1, PRESCAN))
    return F.coalesce(*signed, F.when(nul > 0, F.concat(F.lit("NUL byte at offset "), (nul - 1).cast("string"))))


def replacement_ratio(text: Column) -> Column:
    n = F.length(text)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))) / n)


def decode_as(body: bytes, label: str) -> str:
    if label == "windows-1252":  # the web maps the five free bytes to controls
        return body.decode("cp1252", errors="cp1252-controls")
    return body.decode(codec_of(label) or "cp1252", errors="replace")


def is_utf8(body: bytes) -> bool:
    try:
        body.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def has_script(text: str) -> bool:
    """Any letter of the scripts that the candidate encodings are for."""
    # Ranges of the scripts.
    spans = ((0x3000, 0x303F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF60))
    return any(a <= ord(c) <= b for c in text if ord(c) >= 0x3000 for a, b in spans)


def detect(body: bytes) -> tuple[str, float] | None:
    """An encoding that fits undeclared bytes, with a confidence."""
    high = not body.isascii()
    if not body:
        return None
    if is_utf8(body):
        return ("utf-8" if high else "us-ascii"), 0.99
    fitting = [c for c in CANDIDATES if REPLACEMENT not in (t := decode_as(body, c)) and has_script(t)]
    return (fitting[0], 0.7 if len(fitting) == 1 else 0.55) if fitting else None


def choose(body: bytes, declared: list[tuple[str, str]]) -> tuple[str, str, float, bool, bool]:
    """(encoding, source, confidence, upgraded, overridden) from declarations in their order of rank."""
    for number, (label, source) in enumerate(declared):
        if label == "utf-8":
            if is_utf8(body):
                return label, source, 1.0, False, number > 0
        elif label in ("iso-8859-1", "us-ascii"):
            upgrade = any(0x80 <= b <= 0x9F for b in body) or (label == "us-ascii" and not body.isascii())
            return ("windows-1252" if upgrade else label), source, 1.0, upgrade, number > 0
        elif codec_of(label) is not None:
            return label, source, 1.0, False, number > 0
    found = detect(body)
    if found:
        return found[0], "detected", found[1], False, bool(declared)
    return ERA_DEFAULT, "era-default", 0.0, False, bool(declared)


DECODED = "text string, chosen_encoding string, chosen_source string, detection_confidence double, cp1252_upgrade boolean, declaration_overridden boolean"


def decode_column(body: Column, mark: Column, header: Column, meta: Column, meta_source: Column) -> Column:
    """Vectorised decoding of text bodies; the declarations come from native expressions."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        import codecs

        codecs.register_error("cp1252-controls", lambda e: ("".join(map(chr, e.object[e.start : e.end])), e.end))
        for columns in batches:
            rows = []
            for raw, bom, http, label, source in zip(*columns, strict=True):
                if raw is None:
                    rows.append((None,) * 6)
                    continue
                raw = bytes(raw)
                if bom is not None:
                    text = raw.decode({"utf-8": "utf-8-sig", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}[bom], errors="replace").removeprefix("﻿")
                    rows.append((text, bom, "detected", 1.0, False, False))
                    continue
                declared = [(x, s) for x, s in ((http, "http-header"), (label, source)) if x is not None]
                encoding, chosen, confidence, upgraded, overridden = choose(raw, declared)
                rows.append((decode_as(raw, encoding), encoding, chosen, confidence, upgraded, overridden))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECODED.split(", ")])

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, DECODED)(body, mark, header, meta, meta_source)


def plain_decoding(body: Column, mark: Column, header: Column, meta: Column, meta_source: Column) -> Column:
    """`decode_column` by built-in functions for bodies without a byte mark that are valid UTF-8, or declared as Latin-1, ASCII or
    windows-1252; null for those whose encoding has to be found out or is another one."""
    chars = body.cast("string")
    valid = F.is_valid_utf8(chars)
    ascii_only = valid & (F.octet_length(body) == F.length(chars))
    latin = F.decode(body, "ISO-8859-1")
    western = F.translate(latin, "".join(map(chr, range(0x80, 0xA0))), WESTERN)
    single = ("iso-8859-1", "us-ascii", "windows-1252")
    usable = lambda x: F.coalesce(((x == "utf-8") & valid) | x.isin(*single), F.lit(False))
    passed = lambda x: x.isNull() | ((x == "utf-8") & ~valid)

    def row(text: Column, label: Column, source: Column, confidence: float, upgraded: Column, overridden: Column) -> Column:
        values = (text, label, source, F.lit(confidence), upgraded, overridden)
        return F.struct(*[v.alias(c.split()[0]) for v, c in zip(values, DECODED.split(", "), strict=True)])

    def declared(label: Column, source: Column, overridden: Column) -> Column:
        upgraded = ((label == "iso-8859-1") & latin.rlike(r"[\x{80}-\x{9f}]")) | ((label == "us-ascii") & ~ascii_only)
        text = F.when(label == "utf-8", chars).when(upgraded | (label == "windows-1252"), western).otherwise(latin)
        return row(text, F.when(upgraded, "windows-1252").otherwise(label), source, 1.0, upgraded, overridden)

    found = row(chars, F.when(ascii_only, "us-ascii").otherwise("utf-8"), F.lit("detected"), 0.99, F.lit(False), header.isNotNull() | meta.isNotNull())
    choice = (
        F.when(usable(header), declared(header, F.lit("http-header"), F.lit(False)))
        .when(passed(header) & usable(meta), declared(meta, meta_source, header.isNotNull()))
        .when(passed(header) & passed(meta) & valid & (F.octet_length(body) > 0), found)
    )
    return F.when(body.isNotNull() & mark.isNull(), choice)


def decoded(body: Column, content_type: Column) -> Column:
    """The whole decision on a body: kind, text, declarations, choice and fit."""
    window = F.decode(F.substring(body, 1, PRESCAN), "ISO-8859-1")
    header, meta = header_charset(content_type), meta_charset(window)
    binary = F.when(byte_mark(body).isNull(), binary_reason(body))
    facts = F.struct(F.when(binary.isNull(), body).alias("body"), byte_mark(body).alias("mark"), header.alias("header"), meta.alias("meta"))
    plain = bound(facts, lambda x: plain_decoding(x["body"], x["mark"], x["header"], x["meta"]["label"], x["meta"]["source"]))
    left = F.when(binary.isNull() & plain.isNull(), body)  # Python gets nulls for all other rows
    result = F.coalesce(plain, decode_column(left, byte_mark(body), header, meta["label"], meta["source"]))

    def told(x: Column) -> Column:
        r, http, meta_label = x["result"], x["header"], x["meta"]["label"]
        ratio = replacement_ratio(r["text"])
        return F.struct(
            F.when(x["binary"].isNull(), "text").otherwise("binary").alias("kind"),
            r["text"].alias("text"),
            http.alias("http_charset"),
            meta_label.alias("meta_charset"),
            (http.isNotNull() & meta_label.isNotNull() & (http != meta_label)).alias("declaration_conflict"),
            r["chosen_encoding"].alias("chosen_encoding"),
            F.coalesce(r["chosen_source"], F.lit("none")).alias("chosen_source"),
            F.coalesce(r["detection_confidence"], F.lit(0.0)).alias("detection_confidence"),
            F.coalesce(r["cp1252_upgrade"], F.lit(False)).alias("cp1252_upgrade"),
            F.coalesce(r["declaration_overridden"], F.lit(False)).alias("declaration_overridden"),
            F.coalesce(ratio, F.lit(0.0)).alias("replacement_ratio"),
            F.coalesce(ratio > REPLACEMENT_THRESHOLD, F.lit(False)).alias("degraded"),
            x["binary"].alias("binary_reason"),
        )

    return bound(F.struct(result.alias("result"), header.alias("header"), meta.alias("meta"), binary.alias("binary")), told)
