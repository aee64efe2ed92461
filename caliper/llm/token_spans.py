"""Token counts by section: a document is encoded once as a whole, and its tokens' character spans are joined with the
spans of its sections. Byte-level BPE loses nothing, so the tokens' byte lengths add up to their offsets.

A token that crosses a boundary is allotted by one of three rules: "start", the section of its first character; "most",
the section with most of its characters, the earlier on a tie; "share", each section its share of the characters.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from caliper.llm.blocks import blocks

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern of the byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "most", "share")


def line_sections(text: str) -> np.ndarray:
    """Character offsets at which the lines of text start; a line break belongs to the line that it ends."""
    return np.array([0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))])


class Encoder:
    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("sections", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters. A token that begins or ends within a character is said to begin
        with that character, and to end where the next token begins."""
        ids = np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)
        ends = np.cumsum(self.length[ids])
        if len(text) != (ends[-1] if len(ends) else 0):  # not ASCII
            data = np.frombuffer(text.encode("utf-8"), np.uint8)
            chars = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
            starts = chars[np.r_[0, ends[:-1]]] - 1
            return starts, np.r_[starts[1:], len(text)]
        return np.r_[0, ends[:-1]], ends


def allot(start: np.ndarray, end: np.ndarray, sections: np.ndarray, total: int, rule: str) -> np.ndarray:
    """Tokens of each section, where sections holds the offsets at which they begin and `total` is the text's length.
    Spans that are empty (a further token of one character) count for the section that holds the character."""
    bounds = np.r_[sections, max(total, 1)]
    first = np.searchsorted(bounds, start, side="right") - 1
    first = np.minimum(first, len(sections) - 1)
    out = np.zeros(len(sections))
    crossing = end > bounds[first + 1]
    if rule == "start" or not crossing.any():
        return out + np.bincount(first, minlength=len(sections))
    out += np.bincount(first[~crossing], minlength=len(sections))
    for s, e, f in zip(start[crossing], end[crossing], first[crossing], strict=True):
        over = np.minimum(bounds[f + 1 :], e) - np.maximum(bounds[f:-1], s)
        over = over[: int(np.searchsorted(bounds, e)) - f]
        if rule == "most":
            out[f + int(np.argmax(over))] += 1
        else:
            out[f : f + len(over)] += over / (e - s)
    return out


def section_tokens(docs: DataFrame, rule: str = "most", sections: Callable[[str], np.ndarray] = line_sections, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens) for each section of each row of docs (doc_id, text).

    Null and empty texts have one section without characters or tokens. The tokens of a document's sections add up to
    doc_tokens. Other columns are ignored; repeated rows are counted each; no shuffle. The vocabulary file is read by the
    driver and sent to the tasks (1 MB).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(tokenizer, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for part in blocks(b, 1):
                rows: list[list[np.ndarray]] = [[] for _ in range(5)]
                ids = []
                for doc, t in zip(part.column(0), part.column(1), strict=True):
                    text = t.as_py() or ""
                    begin = sections(text)
                    s, e = enc.spans(text) if text else (np.empty(0, np.int64), np.empty(0, np.int64))
                    n = allot(s, e, begin, len(text), rule)
                    ids += [doc.as_py()] * len(begin)
                    for col, x in zip(rows, (np.arange(len(begin)), begin, np.r_[begin[1:], len(text)], n, np.full(len(begin), len(s))), strict=True):
                        col.append(x)
                cat = [np.concatenate(c) if c else np.empty(0) for c in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cat[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in cat[1:3]), pa.array(cat[3].astype(float)), pa.array(cat[4].astype(np.int64))],
                    names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens double, doc_tokens long")
