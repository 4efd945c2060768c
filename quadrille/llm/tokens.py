"""Token ids of whole texts, by the tokenizers library, as little-endian unsigned 32-bit integers in a BINARY column."""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 2
#: Chunks of which a worker remembers the ids; about 200 bytes each. The first ones seen stay: frequent ones come early.
REMEMBERED = 700_000
#: Splits only where the byte-level pre-tokenizer splits in any case: before a single blank, around runs of white space,
#: and between letters or digits and the full stops or commas after them.
_CHUNKS = re.compile(r" ?[^\W_]++(?=[ \t-\r.,]|\Z)|[.,]++(?=[^\W_]|[ \t-\r]|\Z)| ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+").findall
#: A text with other white space, or with what one library may take for it, is encoded in one piece.
_ODD = re.compile("[%s]" % "".join(chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF))).search


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(ids: list[int]) -> bytes:
    data = array("I", ids)
    if sys.byteorder == "big":
        data.byteswap()
    return data.tobytes()


class KnownChunks(dict):
    """Chunk to ids; a chunk that isn't known is encoded when it is asked for, and remembered while there is room."""

    def __init__(self, tokenizer: Tokenizer, most: int) -> None:
        super().__init__()
        self.tokenizer, self.merge, self.most = tokenizer, tokenizer.model.tokenize, most
        tokenizer.model._resize_cache(0)  # this dict takes its place
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = dict(zip((b for b in range(256) if b not in plain), range(256, 512), strict=False))  # the byte-level alphabet
        self.blank = chr(self.signs[32])

    def __missing__(self, chunk: str) -> bytes:
        letters = chunk[1:] if chunk[0] == " " else chunk
        if letters.isalpha():  # letters, with or without a blank before them, are one piece and go to the merges at once
            if chunk.isascii():
                signs = letters if letters is chunk else self.blank + letters
            else:
                signs = chunk.encode().decode("latin-1").translate(self.signs)
            found = packed([t.id for t in self.merge(signs)])
        else:
            found = packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(self) < self.most:
            self[chunk] = found
        return found


class ByteLevelEncoder:
    """Equal to Tokenizer.encode(text, add_special_tokens=False) of a byte-level BPE, but each chunk of a text is encoded once per worker.

    A text with an added token, such as <|endoftext|>, is encoded in one piece, as the library takes it for that token.
    The pre-tokenizer never joins what stands on both sides of a cut, and merges never cross its pieces; so the ids of a
    text are those of its chunks, one after the other."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(added)).search if added else lambda _: None
        self.known = KnownChunks(self.tokenizer, remembered)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.known.__getitem__
        return [self.whole(t) if _ODD(t) or self.added(t) else b"".join(map(ids, _CHUNKS(t))) for t in texts]


_encoders: dict[tuple[str, int], ByteLevelEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> ByteLevelEncoder:
    if (path, remembered) not in _encoders:
        _encoders.clear()
        _encoders[path, remembered] = ByteLevelEncoder(path, remembered)
    return _encoders[path, remembered]


def token_ids(df: DataFrame, text: str = "text", *, path: str, end_id: int | None = END_ID, keys: tuple[str, ...] = ("doc_id",), out: str = "ids", form: Callable[[bytes], bytes] = bytes, remembered: int = REMEMBERED) -> DataFrame:
    """keys and, in `out`, the ids of the whole `text` (null: empty), then end_id, in the form told. One row for each row; no shuffle."""
    rows = df.select(*keys, text)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(out, T.BinaryType(), False)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [form(x + end) for x in enc.encode([t or "" for t in part.column(len(keys)).to_pylist()])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(ids, pa.binary())], [*keys, out])

    return rows.mapInArrow(encode, schema)
