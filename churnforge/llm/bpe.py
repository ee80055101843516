"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at places where the pre-splitting pattern always has a boundary, so that one regular-expression run
never sees an unbounded text; ids are turned back into bytes from the raw rank table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnforge.llm.textbatch import give_back, slices, texts

#: Texts longer than this many characters are encoded in pieces.
PIECE_CHARS = 1 << 16
#: A single space between two other characters that are no white space: the pattern starts a new match there whatever
#: stands on either side, since a match holds white space only at its start or throughout.
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Unicode white space, as the pattern's engine has it. That engine runs out of stack on very long runs, so runs of this
#: length are matched here: all but the last character before a word is one match, at the text's end the whole run is.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")

SCHEMA = "n_tokens long, ids binary, decoded binary"


def vocabulary(rank_file: str) -> str:
    """Path of a rank file: an existing path as it is, else the name of a file that the tokenizer package ships."""
    import os
    import public_tokenizers
    return rank_file if os.path.isabs(rank_file) else public_tokenizers.path(rank_file)


def ranks(rank_file: str) -> dict[bytes, int]:
    with open(vocabulary(rank_file), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def codec(rank_file: str):
    """(encoder, id -> bytes) once per Python worker."""
    import public_tokenizers
    import tiktoken
    known = ranks(rank_file)
    table: list = [None] * (max(known.values()) + 1)
    for token, rank in known.items():
        table[rank] = token
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}), table


@lru_cache(maxsize=4)
def whole_encoder(rank_file: str):
    """An encoder that takes a text as one match; made only where a text needs it."""
    import tiktoken
    return tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks(rank_file), special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in order, cut at the first safe boundary after each `size` characters; without one it stays whole."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, encoder, rank_file: str) -> list[int]:
    """Token ids of a text by the default pattern; special-token strings are ordinary text."""
    if len(text) < 1_000:
        return encoder.encode_ordinary(text)
    ids, start = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += [i for piece in pieces(text[start:run.start()]) for i in encoder.encode_ordinary(piece)]
        ids += whole_encoder(rank_file).encode_ordinary(text[run.start():end])
        start = end
    return ids + [i for piece in pieces(text[start:]) for i in encoder.encode_ordinary(piece)]


def bpe_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rank_file: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (the bytes the ids stand for) per row.

    One row per input row, repeated rows and null ids included (none for an empty table); a null or empty text has no
    tokens. Nothing is shuffled. `rank_file` is an absolute path that every executor has, or the name of a file of the installed
    tokenizer package, whose pre-splitting pattern applies."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()                                         # of the stage before
        encoder, table = codec(rank_file)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                found = [encode(t, encoder, rank_file) for t in texts(part.column(text_col))]
                yield pa.RecordBatch.from_arrays([
                    part.column(id_col),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([np.asarray(x, "<u4").tobytes() for x in found], pa.binary()),
                    pa.array([b"".join([table[i] for i in x]) for x in found], pa.binary()),
                ], names=[id_col, "n_tokens", "ids", "decoded"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
