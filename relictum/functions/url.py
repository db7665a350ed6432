"""URLs, paths and hashes. Native expressions where a URL is already normal; a vectorised function where it must be parsed."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY_MODIFIER = "id_"
FRAME_MODIFIER = "if_"
REPLAY = r"(?i)/web/(\d{4,14})([a-z_]*)/(.+)$"
# Extensions that make a link a document.
DOCUMENT_EXTENSIONS = ("pdf", "doc", "docx", "rtf", "txt", "xls", "xlsx", "ppt", "pptx", "csv", "zip", "gz", "tar", "sit", "hqx", "rss", "xml", "mp3", "wav", "aif", "aiff", "mov", "mpg", "mpeg", "avi", "wmv", "ram", "rm", "swf")


def replay_modifier(relation: Column) -> Column:
    return F.when(relation == "frame", FRAME_MODIFIER).otherwise(IDENTITY_MODIFIER)


def replay_url(endpoint: Column, ts: Column, original: Column, modifier: Column) -> Column:
    return F.concat(F.regexp_replace(endpoint, "/+$", ""), F.lit("/"), ts, modifier, F.lit("/"), original)


def replay_timestamp(url: Column) -> Column:
    return F.when(url.rlike(REPLAY), F.regexp_extract(url, REPLAY, 1))


def replay_parts(url: Column) -> Column:
    part = lambda i: F.regexp_extract(url, REPLAY, i)
    return F.when(url.rlike(REPLAY), F.struct(part(1).alias("timestamp"), part(2).alias("modifier"), part(3).alias("original_url")))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without credentials and port; null if it has none."""
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.lower(host), F.lit(""))


def host_matches(host: Column, allowed: Column) -> Column:
    return (F.lower(host) == F.lower(allowed)) | F.lower(host).endswith(F.concat(F.lit("."), F.lower(allowed)))


def extension_of(url: Column) -> Column:
    last = F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"[^/]*$", 0)
    return F.lower(F.regexp_extract(last, r"\.([^.]*)$", 1))


def refined_relation(relation: Column, resolved: Column) -> Column:
    return F.when((relation == "link") & extension_of(resolved).isin(*DOCUMENT_EXTENSIONS), "document").otherwise(relation)


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def short_hash(value: Column) -> Column:
    return F.substring(sha256(value), 1, 8)


def item_id(url: Column) -> Column:
    return F.substring(sha256(url), 1, 16)


def store_path(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("objects"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def safe_segment(segment: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(segment, r"[^A-Za-z0-9._-]", "_"), r"^\.+", "_")
    return F.when(cleaned.isin("", "_"), "_").otherwise(F.substring(cleaned, 1, 96))


def local_path(url: Column) -> Column:
    """Where a recovered file lies: site/host/segments, a directory index for names without a dot, a hash for a query."""
    bare = without_fragment(url)
    query = F.regexp_extract(bare, r"\?.*$", 0)
    path = F.regexp_extract(bare, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), safe_segment)
    tail = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    named = tail.contains(".")
    last = F.when(named, tail).otherwise("index.html")
    above = F.when(named, F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))).otherwise(segments)
    dot = F.regexp_extract(last, r"\.[^.]*$", 0)
    stem = F.substring(last, F.lit(1), F.length(last) - F.length(dot))
    final = F.when(F.length(query) > 1, F.concat(stem, F.lit("__q"), short_hash(query), dot)).otherwise(last)
    placed = F.concat_ws("/", F.concat(F.array(F.lit("site"), safe_segment(host_of(url))), above, F.array(final)))
    return F.when(host_of(url).isNotNull(), placed).otherwise(F.concat(F.lit("site/_unparseable/"), short_hash(url)))


DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
SPECIAL = frozenset((*DEFAULT_PORTS, "file"))


def remove_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for number, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = number == len(parts) - 1
        if plain == "..":
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/".join(out)


def encode_part(text: str, safe: str) -> str:
    return quote(text, safe=safe + "%")


def join_url(raw: str | None, base: str | None) -> str | None:
    """`raw` against `base` by the living URL standard, as far as web pages need it; None if it is no URL."""
    if raw is None:
        return None
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    scheme, sep, rest = text.partition(":")
    if not (sep and re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", scheme)):
        scheme, rest = "", text
    scheme = scheme.lower()
    basis = split_url(base) if base is not None else None
    if scheme and scheme not in SPECIAL:
        return f"{scheme}:{rest}"
    if not scheme or (basis and basis[0] == scheme and not re.match(r"[/\\]{2}", rest) and scheme != "file"):
        if basis is None:
            return None
        scheme = scheme or basis[0]
        if scheme not in SPECIAL:
            return None
        body, hash_sign, fragment = rest.partition("#")
        body, mark, query = body.partition("?")
        body = body.replace("\\", "/")
        if body.startswith("//"):
            rest = rest.replace("\\", "/", 2)
        else:
            path = body if body.startswith("/") else (basis[2].rpartition("/")[0] + "/" + body if body else basis[2])
            tail = mark + query if mark else (basis[3] if not body else "")
            return build_url(scheme, basis[1], path, tail, hash_sign + fragment)
    match = re.match(r"[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?", rest, re.DOTALL)
    return build_url(scheme, match[1], match[2].replace("\\", "/"), match[3] or "", match[4] or "")


def split_url(url: str) -> tuple[str, str, str, str] | None:
    match = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):[/\\]{0,2}([^/\\?#]*)([^?#]*)(\?[^#]*)?", url, re.DOTALL)
    return (match[1].lower(), match[2], match[3] or "/", match[4] or "") if match else None


def build_url(scheme: str, authority: str, path: str, query: str, fragment: str) -> str | None:
    user, at, host = authority.rpartition("@")
    port = ""
    if (m := re.fullmatch(r"(\[[0-9A-Fa-f:.]+\]|[^:]*)(?::([0-9]*))?", host)) is None:
        return None
    host, port = m[1].lower(), (m[2] or "").lstrip("0") or ("0" if m[2] else "")
    if len(port) > 5:  # before it becomes a number: a page may hold one of any length
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if not host or re.search(r"[\s<>^|%\\]", host) or (port and int(port) > 65535):
        return None
    port = "" if not port or int(port) == DEFAULT_PORTS.get(scheme) else f":{int(port)}"
    path = encode_part(remove_dots("/" + path.lstrip("/") if not path.startswith("/") else path), "/:@!$&'()*+,;=~[]|^\\")
    query = encode_part(query, "?/:@!$&()*+,;=~[]|^\\`{}") if query not in ("", "?") else query
    fragment = encode_part(fragment, "#?/:@!$&'()*+,;=~[]|^\\{}") if fragment not in ("", "#") else fragment
    return f"{scheme}://{user}{at}{host}{port}{path or '/'}{query}{fragment}"


# URLs that are normal already, as patterns: no character that would be encoded, no port, credentials, upper case in the host or
# dot segment. What they say holds for `join_url` too; all else is its work.
HOST = r"https?://[a-z0-9._-]+"
PATH = r"[A-Za-z0-9_.~/:@!$&'()*+,;=|^%\[\]-]*"
TAIL = r"(?:\?[A-Za-z0-9_.~?/:@!$&()*+,;=|^`{}%\[\]-]*)?(?:#[A-Za-z0-9_.~?/:@!$&'()*+,;=|^{}%\[\]-]*)?"
NORMAL = rf"\A{HOST}/{PATH}{TAIL}\z"
FROM_ROOT = rf"\A/(?!/){PATH}{TAIL}\z"
FROM_FOLDER = rf"\A(?!/){PATH.replace(':', '').removesuffix('*')}+{TAIL}\z"
DOTS = r"(?i)(?:\A|/)(?:\.|%2e)"


def plain_url(raw: Column, base: Column) -> Column:
    """`join_url` by built-in functions where patterns show that nothing has to be encoded, lowered or taken out: a normal URL, or a
    path from the root or the folder of a normal base. Null where they do not show it."""
    tame = ~raw.rlike(DOTS)
    based = base.rlike(NORMAL) & ~base.rlike(DOTS)
    return (
        F.when(raw.rlike(NORMAL) & tame, raw)
        .when(raw.rlike(FROM_ROOT) & tame & based, F.concat(F.regexp_extract(base, rf"\A{HOST}", 0), raw))
        .when(raw.rlike(FROM_FOLDER) & tame & based, F.concat(F.regexp_extract(base, rf"\A{HOST}/(?:[^?#]*/)?", 0), raw))
    )


def parsed_url(raw: Column, base: Column) -> Column:
    """Vectorised `join_url`; each pair of a batch is parsed once."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, bases in batches:
            pairs = list(zip(raws, bases, strict=True))
            known = {p: join_url(*p) for p in set(pairs)}
            yield pd.Series([known[p] for p in pairs], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(raw, base)


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn` of a value that is worked out once, however often `fn` names it."""
    return F.get(F.transform(F.array(value), fn), 0)


def resolve_url(raw: Column, base: Column) -> Column:
    """`raw` against `base`; null where there is no URL. Python gets only what `plain_url` leaves; of all other rows, nulls."""

    def parted(x: Column) -> Column:
        return bound(F.struct(plain_url(x["raw"], x["base"]).alias("url"), x["raw"].alias("raw"), x["base"].alias("base")), lambda y: F.struct(y["url"].alias("url"), F.when(y["url"].isNull(), y["raw"]).alias("raw"), F.when(y["url"].isNull(), y["base"]).alias("base")))

    known = bound(F.struct(raw.cast("string").alias("raw"), base.cast("string").alias("base")), parted)
    return F.coalesce(known["url"], parsed_url(known["raw"], known["base"]))


def capture_key(url: Column) -> Column:
    """The identity under which captures of one URL meet: normalised, without its fragment; the text itself if it is no URL."""
    return F.coalesce(without_fragment(resolve_url(url, F.lit(None).cast("string"))), url)
