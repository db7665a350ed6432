"""SentencePiece encoding that keeps the place of every piece in the source, and decoding.

A text is normalised by the longest prefixes of the model's compiled character map, and each normalised character keeps
the byte of the source that it came from. The library then segments the normalised text as it stands. A piece that starts at
one normalised character and ends before another covers the source bytes between their origins; so every piece has a span of
the original text, whatever the normalisation replaced, put in or left out. Of a character that falls back to bytes the last
byte's piece has the span and the others are empty, as are begin and end ids.

Defined cases: a null text counts as empty; an empty text has begin and end ids alone, if those are asked for; repeated rows
each get their pieces; very long texts are encoded whole; an empty table gives an empty table; columns of the input with the
names of the added columns are replaced.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm.common import free_name, text_udf

SPACE = "▁"
# Kinds of pieces in a model file (fixed values of its format).
USER_DEFINED, BYTE = 4, 6

TYPES = {"n_tokens": "long", "ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "packed": "binary", "covered": "long", "decoded": "string"}


@functools.lru_cache(maxsize=2)
def compiled_rules(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over UTF-8 whose values are places among the replacements,
    which end by a zero byte."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    replaced = blob[4 + size :]
    offsets = (units >> 10) << ((units & (1 << 9)) >> 6)
    labels, leaf, values = units & 0x800000FF, (units >> 8) & 1, units & 0x7FFFFFFF
    letters = np.arange(1, 256)
    rules: dict[str, str] = {}
    held = [(b"", int(offsets[0]))]
    while held:
        prefix, base = held.pop()
        nodes = base ^ letters
        inside = nodes < len(units)
        for byte in letters[inside][labels[nodes[inside]] == letters[inside]].tolist():
            node = base ^ byte
            key, below = prefix + bytes([byte]), node ^ int(offsets[node])
            if leaf[node]:
                at = int(values[below])
                rules[key.decode()] = replaced[at : replaced.index(b"\0", at)].decode()
            held.append((key, below))
    return rules


class PieceModel:
    """What a model file says, ready to encode."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        said = sentencepiece_model_pb2.ModelProto()
        said.ParseFromString(proto)
        trained, normal = said.trainer_spec, said.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.fallback = trained.byte_fallback
        # Normalised characters of each piece. Of the bytes that spell a character the last one counts for it.
        self.sizes = np.array([1 if p.type == BYTE else len(p.piece) for p in said.pieces], np.int32)
        self.spells = np.array([p.type == BYTE for p in said.pieces])
        self.continues = np.array([p.type == BYTE and 0x80 <= int(p.piece[3:-1], 16) < 0xC0 for p in said.pieces])
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

        self.dummy, self.suffix = normal.add_dummy_prefix, trained.treat_whitespace_as_suffix
        self.squeeze, self.escape = normal.remove_extra_whitespaces, normal.escape_whitespaces
        self.rules = compiled_rules(normal.precompiled_charsmap)
        symbols = {p.piece for p in said.pieces if p.type == USER_DEFINED}
        self.symbols = prefixes({s: s for s in symbols})
        self.mapped = prefixes(self.rules)
        starts = {s[0] for s in symbols} | {s[0] for s in self.rules} | ({" "} if self.squeeze else set())
        self.special = re.compile("[" + "".join(map(re.escape, sorted(starts))) + "]") if starts else None
        # The same merges over text that is normalised already.
        said.normalizer_spec.precompiled_charsmap = b""
        said.normalizer_spec.add_dummy_prefix = said.normalizer_spec.remove_extra_whitespaces = said.normalizer_spec.escape_whitespaces = False
        self.merging = sentencepiece.SentencePieceProcessor(model_proto=said.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the byte of the source it came from."""
        raw = np.frombuffer(text.encode(), np.uint8)
        places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int32)
        n, pos = len(text), 0
        if self.squeeze:  # white space at the head goes
            while pos < n and (found := self.longest(text, pos))[0] == " ":
                pos += found[1]
        if pos == n:
            return "", np.zeros(1, np.int32)
        out, origin = [], []
        if self.dummy and not self.suffix:
            out.append(" ")
            origin.append(places[pos : pos + 1])
        blank = self.squeeze
        while pos < n:
            met = self.special.search(text, pos) if self.special else None
            to = met.start() if met else n
            if to > pos:
                out.append(text[pos:to])
                origin.append(places[pos:to])
                blank = False
            if not met:
                break
            put, used = self.longest(text, to)
            if blank:
                put = put.lstrip(" ")
            if put:
                out.append(put)
                origin.append(np.full(len(put), places[to]))
                blank = self.squeeze and put.endswith(" ")
            pos = to + used
        normal, end = "".join(out), places[-1:]
        if self.squeeze and (kept := len(normal.rstrip(" "))) < len(normal):
            flat = np.concatenate(origin)
            normal, origin, end = normal[:kept], [flat[:kept]], flat[kept : kept + 1]
        if self.dummy and self.suffix:
            normal += " "
            origin.append(end)
        return normal.replace(" ", SPACE) if self.escape else normal, np.concatenate([*origin, end])

    def longest(self, text: str, at: int) -> tuple[str, int]:
        """What stands for the longest prefix of text[at:] that a symbol or rule names, and its length."""
        for table in (self.symbols, self.mapped):
            for size, rules in table.get(text[at], ()):
                put = rules.get(text[at : at + size])
                if put is not None:
                    return put, size
        return text[at], 1

    def encode(self, text: str, *, begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each the bytes of the source where its span begins and ends."""
        normal, origin = self.normalise(text)
        ids = np.array(self.merging.encode(normal, num_threads=1), np.int32)
        if self.fallback:
            sizes = self.sizes[ids]
            follows = np.append(self.continues[ids[1:]], False)[: len(ids)]
            sizes[follows & self.spells[ids]] = 0
        else:  # neighbours without an id are one piece of any length
            sizes = np.array([len(p) for p in self.merging.encode(normal, out_type=str, num_threads=1)], np.int32)
        stop = np.cumsum(sizes, dtype=np.int32)
        begins, ends = origin[stop - sizes], origin[stop]
        head = [[self.begin], [0], [0]] if begin and self.begin >= 0 else [[], [], []]
        tail = [[self.end], origin[-1:], origin[-1:]] if end and self.end >= 0 else [[], [], []]
        ids, begins, ends = (np.concatenate([h, x, t]).astype(np.int32) for h, x, t in zip(head, (ids, begins, ends), tail, strict=True))
        return ids, begins, ends

    def decode(self, ids: Sequence[int]) -> str:
        return self.library.decode(list(ids))


def prefixes(rules: dict[str, str]) -> dict[str, list[tuple[int, dict[str, str]]]]:
    """Rules by their first character, then by falling length."""
    out: dict[str, dict[int, dict[str, str]]] = {}
    for key, put in rules.items():
        out.setdefault(key[0], {}).setdefault(len(key), {})[key] = put
    return {c: sorted(sized.items(), reverse=True) for c, sized in out.items()}


@functools.lru_cache(maxsize=2)
def loaded(proto: bytes) -> PieceModel:
    return PieceModel(proto)


def lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encode_pieces(docs: DataFrame, model_path: str, *, columns: Sequence[str] = ("ids", "begins", "ends"), begin: bool = True, end: bool = True, text_col: str = "text") -> DataFrame:
    """`docs` with the columns asked for: n_tokens, ids, begins and ends (spans in bytes of the source), packed (ids as
    little-endian unsigned 32-bit integers), covered (bytes of the source that pieces cover), decoded (the text that the ids
    say)."""
    with open(model_path, "rb") as file:  # part of the driver's installation; tasks get its bytes
        proto = file.read()

    def run(texts: list[str]) -> pa.Array:
        model = loaded(proto)
        found = [model.encode(t, begin=begin, end=end) for t in texts]
        made = {
            "n_tokens": lambda: pa.array([len(i) for i, _, _ in found], pa.int64()),
            "ids": lambda: lists([i for i, _, _ in found]),
            "begins": lambda: lists([b for _, b, _ in found]),
            "ends": lambda: lists([e for _, _, e in found]),
            "packed": lambda: pa.array([i.astype("<u4").tobytes() for i, _, _ in found], pa.binary()),
            "covered": lambda: pa.array([int((e - b).sum(dtype=np.int64)) for _, b, e in found], pa.int64()),
            "decoded": lambda: pa.array([model.decode(i.tolist()) for i, _, _ in found], pa.string()),
        }
        return pa.StructArray.from_arrays([made[c]() for c in columns], names=list(columns))

    encode = text_udf(run, "struct<" + ", ".join(f"{c}: {TYPES[c]}" for c in columns) + ">")
    held = docs.drop(*columns)
    name = free_name(held, "pieces") if text_col in held.columns else None
    if name is None:  # the text's own name is among the added ones
        held, text_col = docs.withColumn("__text", F.col(text_col)).drop(*columns), "__text"
        name = free_name(held, "pieces")
    out = held.withColumn(name, encode(F.col(text_col)))
    return out.select(*[F.col(f"`{c}`") for c in held.columns if c != "__text"], *[F.col(f"`{name}`.{c}").alias(c) for c in columns])
