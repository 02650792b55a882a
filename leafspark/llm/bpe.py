"""Byte-level BPE: texts to token ids by a local rank file, and ids back to bytes.

The merges are tiktoken's. A long text is first cut where every match of the splitting pattern ends anyway (before
white space that follows something else), so no call gets an unbounded text and a very long run of white space, which
the pattern's look-ahead would walk through again and again, is encoded as the single match that it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafspark.llm.shared import pick

#: Texts over so many characters are cut into parts of about this size.
PART = 50_000
#: Runs of white space over this length are encoded by themselves.
LONG_SPACE = 500
#: White space as the tokenizer's pattern knows it (fixed values; Python's own class has four control characters more).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_loaded: dict[tuple[str, str], object] = {}


def rank_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def encoding(path: str, pattern: str | None = None):
    """The encoding of a rank file; loaded once in each Python worker."""
    import public_tokenizers
    import tiktoken
    pattern = pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def parts(text: str, size: int = PART, long_space: int = LONG_SPACE) -> Iterator[tuple[str, bool]]:
    """(part, whole): the text in order; whole marks a part that is one match of the pattern.

    Cuts lie between a character that is not white space and white space, where no match of the pattern can reach
    across, or around a long run of white space. Such a run is one match up to its last character, which belongs to
    what follows; a run at the end of the text is one match in full.
    """
    start = at = 0
    for run in re.finditer("[%s]{%d,}" % (SPACE, long_space), text):
        yield from _cut(text, start, run.start(), size)
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start():at], True
        start = at
    yield from _cut(text, start, len(text), size)


def _cut(text: str, start: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    seam = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")
    while end - start > size:
        found = seam.search(text, start + size, end)
        if not found:
            break
        yield text[start:found.start()], False
        start = found.start()
    if start < end:
        yield text[start:end], False


def encode(text: str, enc) -> list[int]:
    """Ids of a whole text, as one call for the whole text would give them."""
    if len(text) <= PART:
        if len(text) < LONG_SPACE or not re.search("[%s]{%d}" % (SPACE, LONG_SPACE), text):
            return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, whole in parts(text):
        ids += enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
    return ids


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text; a null text is empty. One row per row, repeated rows included."""
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            ids = [encode(t or "", enc) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    src = pick(docs, doc_id=id_col, text=text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data): the raw bytes of each row's ids; null ids give no bytes."""
    def run(batches):
        enc = encoding(path)
        for batch in batches:
            data = [enc.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])
    src = pick(tokens, doc_id=id_col, ids=ids_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact): encode, decode and compare each text in one pass.

    The ids never leave the task, so what is written does not grow with the tokens. A null text is an empty one: no
    tokens, the digests of nothing. Every row gives a row.
    """
    def run(batches):
        enc = encoding(path)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = encode(text, enc)
                data = enc.decode_bytes(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                rows[2].append(hashlib.sha256(data).hexdigest())
                rows[3].append(data == text.encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])
    src = pick(docs, doc_id=id_col, text=text_col)
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
