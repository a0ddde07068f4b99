"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is first cut at white space into units (a run of other characters with the one space before
it, or a run of white space). The pre-tokenisation pattern never matches across such a cut, so a
unit's ids do not depend on its neighbours: the ids of frequent units are kept in a bounded table
per Python worker and only new units go through the tokenizer, as a batch. Texts with characters
that Python but not the pattern counts as white space go through the tokenizer whole.

Null text counts as empty. Any length of text is encoded whole; equal texts get equal ids.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from reelgrid.llm.tables import documents, schema_with

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MULTI_50K = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
UNIT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\s.,;:!?%&$#*]|$)| ?\S+|\s+(?!\S)|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Units kept per generation and Python worker, so memory stays bounded.
KEPT_UNITS = 400_000
#: Longer units are encoded but not kept.
KEPT_CHARS = 64


@functools.cache
def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes as themselves, others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@functools.cache
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def from_ranks(path: str):
    """A tokenizer that merges as rank files mean it: the pair whose joined bytes have the lowest rank goes first."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_chars()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((shown(token[:cut]), shown(token[cut:])))
    t = Tokenizer(models.BPE(vocab={shown(k): v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    t.decoder = decoders.ByteLevel()
    return t


@functools.cache
def tokenizer(path: str):
    """Of a rank file or a tokenizers JSON file; special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    t = from_ranks(path) if path.endswith(".tiktoken") else Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@functools.cache
def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by the byte table read backwards."""
    back, vocab = char_bytes(), tokenizer(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Ids of units are kept in two generations; when the younger is full it becomes the older one.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = tokenizer(path), {}, {}
        self.starts_unit = np.array([t[:1] == b" " for t in id_bytes(path)])

    def ids(self, text: str) -> np.ndarray:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Without the offsets of tokens, which cost more than the ids."""
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units. Those of one space and other characters are encoded as one text and cut where a token starts with a space."""
        joined = [u for u in units if u[0] == " " and not u[-1].isspace()]
        apart = [u for u in units if u[0] != " " or u[-1].isspace()]
        found = {u: x.tobytes() for u, x in zip(apart, self.ids_of(apart), strict=True)}
        if joined:
            ids = self.ids("".join(joined))
            raw, at = ids.tobytes(), (np.flatnonzero(self.starts_unit[ids]) * 4).tolist()
            found |= {u: raw[i:j] for u, i, j in zip(joined, at, [*at[1:], len(raw)], strict=True)}
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        plain = [[] if not t or ODD_SPACE.search(t) else UNIT.findall(t) for t in texts]
        if len(self.known) > KEPT_UNITS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*plain).difference(known)
        # A dict in intersection() or difference_update() would be walked through whole for each batch.
        known.update({u: older[u] for u in new if u in older})
        new = new.difference(older)
        known.update(self.learn(list(new)))
        out = [b"".join(map(known.__getitem__, units)) if units or not t else self.ids(t).tobytes() for t, units in zip(texts, plain, strict=True)]
        for u in new:
            if len(u) > KEPT_CHARS:
                del known[u]
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def decode_bytes(ids: bytes, path: str) -> bytes:
    return b"".join(map(id_bytes(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def batches_of(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of the text column, one row at least: bounds what a task holds."""
    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """docs with column ids (array of int); with offsets also starts and ends, in characters of the text.

    A token of a part of a character has the offsets of that whole character. Existing columns of
    those names are replaced; rows stay as they are, repeated ones too.
    """
    keep = docs.drop("ids", "starts", "ends")
    schema = schema_with(keep, **dict.fromkeys(("ids", "starts", "ends") if offsets else ("ids",), "array<int>"))

    def run(batches):
        enc, ints = encoder(path), pa.list_(pa.int32())
        for whole in batches:
            for b in batches_of(whole, text):
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                if offsets:
                    es = enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
                    new = [[e.ids for e in es], [[o[0] for o in e.offsets] for e in es], [[o[1] for o in e.offsets] for e in es]]
                else:
                    new = [[np.frombuffer(x, "<i4") for x in enc.encode(texts)]]
                cols = [*b.columns, *(pa.array(x, ints) for x in new)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return keep.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with columns decoded (binary, exactly the encoded bytes) and decoded_text (U+FFFD for bytes that are no
    whole character, as when ids stop inside one). Null ids give null."""
    keep = df.drop("decoded", "decoded_text")
    schema = schema_with(keep, decoded="binary", decoded_text="string")

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(ids)).to_pylist()
            raw = [None if x is None else decode_bytes(np.asarray(x, "<u4").tobytes(), path) for x in col]
            cols = [*b.columns, pa.array(raw, pa.binary()), pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return keep.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str = MULTI_50K) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; encodes and decodes each text in one pass."""

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for b in batches_of(whole, "text"):
                n, ids_sha, dec_sha = [], [], []
                for ids in enc.encode(b.column(1).to_pylist()):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    dec_sha.append(hashlib.sha256(decode_bytes(ids, path)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: number of tokens, digest of its ids, digest of the bytes its ids decode to."""
    return digests(documents(spark, sf_dir))


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLES: dict[str, str] = {}
