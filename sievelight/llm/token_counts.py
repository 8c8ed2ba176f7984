"""Token counts of a document's fields or sections, by offset-mapped attribution.

A document is encoded once and whole: its fields are joined by a newline, and no field is tokenized on its own. The byte
lengths of its tokens give each token's span; the spans are joined to the sections, which are intervals too, by a binary
search of their bounds. The rule for a token that crosses a boundary: it belongs to the section that holds its first
byte. The newline that ends a section is the section's last character. So each token is counted exactly once, and the counts
of a document's sections add up to the document's own.

Sections are a field's lines (``by_line``) or the whole field. Defined results: a null field is empty; an empty section has
no tokens of its own but its newline's, and the last one none at all; a document without text has one empty section.
Very long texts are encoded whole. Repeated rows are counted once each; a null id is an id; an empty table gives an empty
result; columns that are not named play no part.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.texts import column_type

_ENCODERS: dict[tuple[str, str], tuple] = {}


def encoder(path: str, pattern: str):
    """(encoding, byte length of each id) of a file of ranks; one a worker process."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _ENCODERS[path, pattern]


def attribute(fields: Sequence[str | None], encoding, sizes: np.ndarray, by_line: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(field, section, first character, characters, tokens) for each section of one document, in order. Characters are
    those of the joined text."""
    data = "\n".join(f or "" for f in fields).encode("utf-8", "replace")
    text = np.frombuffer(data, np.uint8)
    ids = encoding.encode_ordinary(data.decode())
    begins = np.cumsum(sizes[ids]) - sizes[ids] if ids else np.zeros(0, np.int64)
    lengths = [len((f or "").encode("utf-8", "replace")) for f in fields]
    field_starts = np.cumsum([0] + [n + 1 for n in lengths[:-1]])
    starts = np.union1d(np.flatnonzero(text == 10) + 1, field_starts) if by_line else field_starts
    tokens = np.diff(np.searchsorted(begins, np.append(starts, len(text) + 1)))
    chars = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))  # characters before each byte
    first = chars[np.minimum(starts, len(text))]
    size = np.diff(np.append(first, chars[-1]))
    field = np.searchsorted(field_starts, starts, side="right") - 1
    section = np.arange(len(starts)) - np.searchsorted(field, field)
    return list(zip(field.tolist(), section.tolist(), first.tolist(), size.tolist(), tokens.tolist()))


def count_tokens(docs: DataFrame, path: str, pattern: str, fields: Sequence[str] = ("text",), by_line: bool = True, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, field, section, start, n_chars, n_tokens, doc_tokens) per section."""
    names = [f"_f{i}" for i in range(len(fields))]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding, sizes = encoder(path, pattern)
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                rows = [attribute(values, encoding, sizes, by_line) for values in zip(*(part[n] for n in names))]
                many = [len(r) for r in rows]
                table = np.array([x for r in rows for x in r], np.int64).reshape(-1, 5).T
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].repeat(many).reset_index(drop=True), "field": np.array(fields, object)[table[0]], "section": table[1],
                    "start": table[2], "n_chars": table[3], "n_tokens": table[4], "doc_tokens": np.repeat([sum(x[4] for x in r) for r in rows], many),
                })

    chosen = docs.select(F.col(doc_id).alias("doc_id"), *(F.col(f).alias(n) for f, n in zip(fields, names)))
    return chosen.mapInPandas(each, f"doc_id {column_type(docs, doc_id)}, field string, section long, start long, n_chars long, n_tokens long, doc_tokens long")
