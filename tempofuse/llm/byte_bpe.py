"""Byte-level BPE encoding and decoding with a sentencepiece model made of the vocabulary (operator 12).

Each byte of a token is written as one character, so that a vocabulary of byte strings is a list of pieces; scored by
their negative rank, sentencepiece's BPE does the merges of that vocabulary. The text is split by the vocabulary's
pattern before, and what stands between two spaces is encoded once by a worker and remembered for a while.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tempofuse.llm.common import chunks

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points of a text that are encoded at once, about; longer texts are cut where no part of the pattern goes across.
LONG_TEXT = 1 << 20
#: Runs between spaces that a worker remembers, each of at most so many characters, before it starts anew.
MEMO_UNITS, MEMO_CHARS = 1 << 18, 64
CUT, WHITE_BEFORE_SPACE = re.compile(r"\S(?= )"), re.compile(r" (?<=\s\s)")

# Characters that became letters and numbers after Unicode 16, by which the rank files' library splits.
NEWER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959"
    "\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"


def byte_characters() -> list[str]:
    """One character for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


# --- the model as a protocol buffer ----------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """One field of a message, by the type of its value."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece k + 1 is token k of the list, in the order of ranks.

    Piece 0 is the unknown one, which the byte characters never need as every byte is a token.
    """
    to = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "⁇") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, "".join(to[b] for b in token)) + _field(2, float(-rank)) + _field(3, normal) for rank, token in enumerate(tokens)]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(45, "⁇")
    identity = _field(1, "identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Decoder:
    """The inverse mapping of one vocabulary: the bytes of every id in a row, and where each id's begin."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.size[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.first = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids in a row; ids beyond the vocabulary are an error."""
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if len(at) and (at.max() >= len(self.size) or not self.size[at].all()):
            raise ValueError("an id that the vocabulary does not have")
        n = self.size[at]
        return self.bytes[np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


class Encoder:
    """Encoder of one vocabulary. Ids are ranks, little-endian uint32 in bytes."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import regex
        import sentencepiece

        ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
        tokens = sorted(ranks, key=ranks.__getitem__)
        if len(set(ranks.values())) != len(ranks) or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary needs one rank for each token, and every byte as a token")
        # a token of itself stands for a part even where no merges lead to it
        self.whole = {t.decode("utf-8"): struct.pack("<I", r) for t, r in ranks.items() if _is_text(t)}
        self.rank = np.array([0, *(ranks[t] for t in tokens)], dtype="<u4")  # by piece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.to = {b: c for b, c in enumerate(byte_characters())}
        # as the pattern of the rank files, on Unicode 16
        source = pattern or public_tokenizers.PATTERN
        older = source.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{NEWER_LETTERS}{NEWER_NUMBERS}])").replace(r"\p{L}+", rf"(?:(?![{NEWER_LETTERS}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{NEWER_NUMBERS}])\p{{N}})+")
        self.parts, self.older_parts = regex.compile(source), regex.compile(older)
        self.newer = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]")
        self.memo: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The parts of a text."""
        older = not text.isascii() and self.newer.search(text)
        return (self.older_parts if older else self.parts).findall(text)

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that begin at a space after another character than white space: no part goes across.

        A text without such places is one block.
        """
        at = 0
        while len(text) - at > LONG_TEXT and (cut := CUT.search(text, at + LONG_TEXT)):
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    def _learn(self, units: list[str]) -> list[bytes]:
        """The ids of each unit of text, by those of its parts; each different part is encoded once."""
        if not units:
            return []
        split = [self.split(u) for u in units]
        ids = {p: self.whole.get(p) for parts in split for p in parts}
        rest = [p for p, known in ids.items() if known is None]
        if rest:
            found = self.model.encode([p.encode().decode("latin-1").translate(self.to) for p in rest], out_type=int, num_threads=1)
            ends = np.cumsum([4 * len(x) for x in found]).tolist()
            data = self.rank[np.fromiter(chain.from_iterable(found), dtype=np.int64, count=ends[-1] // 4)].tobytes()
            ids |= {p: data[a:b] for p, a, b in zip(rest, [0, *ends], ends, strict=False)}
        return [ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts]) for parts in split]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A single space begins a part whatever stands around it, so that runs between single spaces
        are looked up with the space before them; a text with other white space before a space is split whole."""
        heads, units = [], []
        for text in texts:
            head, *rest = [text] if WHITE_BEFORE_SPACE.search(text) else text.split(" ")
            heads.append(head), units.append(rest)
        if len(self.memo) > MEMO_UNITS:
            self.memo = {}
        memo = self.memo
        missing = list(set().union(*units).difference(memo))
        learnt = self._learn(heads + [" " + u for u in missing])
        rare = {}  # too long to be remembered
        for u, ids in zip(missing, learnt[len(heads) :], strict=True):
            (memo if len(u) <= MEMO_CHARS else rare)[u] = ids
        if rare:
            return [head + b"".join([memo.get(u) or rare[u] for u in rest]) for head, rest in zip(learnt, units, strict=False)]
        return [head + b"".join(map(memo.__getitem__, rest)) for head, rest in zip(learnt, units, strict=False)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text of any length."""
        return b"".join([self.encode_all([block])[0] for block in self.blocks(text)])


def _is_text(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


_loaded: dict[tuple, Encoder | Decoder] = {}


def _once(kind: type, *args):
    """The encoder or decoder of this worker; made once."""
    if (kind, *args) not in _loaded:
        _loaded[kind, *args] = kind(*args)
    return _loaded[kind, *args]


# --- over tables -----------------------------------------------------------------------------------------------


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with ids (binary, little-endian uint32) and n_tokens (long) added; columns of these names are replaced.

    Null texts are empty, and empty texts have no ids. Rows are encoded by themselves, whole and whatever their length,
    so that repeated rows and null ids are rows as any other; an empty table gives an empty result.
    """
    docs = docs.drop("ids", "n_tokens")
    schema = StructType(docs.schema.fields + StructType.fromDDL("ids binary, n_tokens long").fields)

    def run(batches):
        bpe = _once(Encoder, path, pattern)
        for batch in chunks(batches, text_col):
            texts = pc.fill_null(batch.column(batch.schema.names.index(text_col)), "").to_pylist()
            ids = bpe.encode_all(texts) if len(texts) > 1 else [bpe.encode(texts[0])]
            more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """rows with decoded (binary) added, the bytes of their ids; null ids are none. A column `decoded` is replaced."""
    rows = rows.drop("decoded")
    schema = StructType(rows.schema.fields + StructType.fromDDL("decoded binary").fields)

    def run(batches):
        bpe = _once(Decoder, path)
        for batch in chunks(batches, ids_col, 4 << 20):
            texts = [bpe.decode(x or b"") for x in batch.column(batch.schema.names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids of each text and of the bytes that they decode to."""
    schema = StructType([docs.schema[id_col]] + StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields)

    def run(batches):
        bpe = _once(Decoder, path)
        for batch in chunks(batches, "ids", 4 << 20):
            ids = batch.column(2).to_pylist()
            digests = [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, digests)], names=schema.names)

    return encode_texts(docs.select(id_col, text_col), path, pattern, text_col).select(id_col, "n_tokens", "ids").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
