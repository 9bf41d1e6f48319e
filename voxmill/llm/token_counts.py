"""Token counts of sections: documents are encoded once, whole, and tokens are attributed by their character spans.

A byte-level BPE vocabulary is lossless: the tokens' bytes laid end to end are
the text. So the spans of tokens are running sums of their lengths, in bytes and
from there in characters, and an interval join by binary search finds the
sections each token meets. A token that crosses a boundary goes

* ``first``: to the section of its first character,
* ``most``: to the section that holds most of its characters, the earlier one in a tie,
* ``share``: to each section in proportion to the characters there.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words

#: Where the vocabulary lies and how it splits text, unless the caller names another.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: The characters that the pattern's white space stands for.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space this long before another character is cut off by hand: the pattern steps back over a whole run, and has no room for a million steps.
LONG_RUN = 10_000


def encode(encoding, text: str, whole: bool = False) -> np.ndarray:
    """Token ids of a text. By ``PATTERN`` a run of n white-space characters before another character is a piece of n - 1 and what starts with its last one, so a long run is cut there, for the same tokens. ``whole``: never cut."""
    if whole or len(text) < LONG_RUN:
        return encoding.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0
    for run in re.finditer(f"(?<![{SPACE}])[{SPACE}]{{{LONG_RUN},}}", text):  # tried at the start of a run only, so in linear time
        if run.end() < len(text):
            parts.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
            at = run.end() - 1
            parts.append(np.asarray(encoding._encode_single_piece(text[run.start() : at]), np.uint32))
    return np.concatenate([*parts, encoding.encode_to_numpy(text[at:], disallowed_special=())])


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets where lines begin; the line feed belongs to the line it ends."""
    return np.concatenate(([0], np.flatnonzero(raw[:-1] == 10) + 1)) if len(raw) else np.zeros(1, np.int64)


def attribute(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section ``[cuts[i], cuts[i + 1])`` and how many cross a boundary. Spans are in order; tokens inside one character share its span."""
    first = np.searchsorted(cuts, start, side="right") - 1
    last = np.maximum(np.searchsorted(cuts, end, side="left") - 1, first)
    crossing = np.flatnonzero(last > first)
    count = np.bincount(np.delete(first, crossing), minlength=len(cuts)).astype(np.float64)
    if rule == "first":
        np.add.at(count, first[crossing], 1)
    else:
        for t in crossing.tolist():
            inside = np.arange(first[t], last[t] + 1)
            hi = np.append(cuts, end[t])[inside + 1]
            part = np.minimum(hi, end[t]) - np.maximum(cuts[inside], start[t])
            if rule == "most":
                count[inside[int(part.argmax())]] += 1
            else:
                count[inside] += part / part.sum()
    return count, len(crossing)


def count_tokens(docs: DataFrame, fields: list[str] | None = None, rule: str = "most", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, n_sections, n_crossing, section_tokens`` for each row of ``docs``.

    Sections are the lines of ``text``, or the ``fields`` laid end to end, in
    order (null ones empty). A null or empty document has no token and one empty
    section (or as many as fields). Special tokens have no meaning inside texts.
    A text of any length is encoded whole, one at a time, with white space of any
    length (by the pattern given here; another one is left to its own limits). Repeated rows each give
    a row; an empty table gives none; other columns are ignored.
    """
    if rule not in ("first", "most", "share"):
        raise ValueError(f"no rule {rule!r}")
    lines = open(vocabulary, "rb").read()  # of fixed size; sent with the plan

    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        for batch in batches:
            data, at = words.utf8(batch.column("text"))
            cut_bytes = batch.column("cuts").to_pylist()
            tokens, sections, crossing, each = [], [], [], []
            for d in range(batch.num_rows):
                raw = data[at[d] : at[d + 1]]
                starts = line_starts(raw)
                ids = encode(encoding, raw.tobytes().decode(), pattern != PATTERN)
                end = np.cumsum(length[ids])
                start = end - length[ids]
                character = np.concatenate((np.cumsum((raw & 0xC0) != 0x80), [0]))  # number of the character each byte belongs to, from 1
                spans = (character[start] - 1, character[end - 1]) if len(end) else (start, end)
                cuts = starts if cut_bytes[d] is None else np.minimum(np.array(cut_bytes[d], np.int64), len(raw))
                chars = np.where(cuts < len(raw), character[np.minimum(cuts, max(len(raw) - 1, 0))] - 1, character[len(raw) - 1] if len(raw) else 0) if len(raw) else np.zeros(len(cuts), np.int64)
                n, crossed = attribute(*spans, chars, rule)
                tokens.append(len(end))
                sections.append(len(cuts))
                crossing.append(crossed)
                each.append(n)
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(sections, pa.int64()), pa.array(crossing, pa.int64()), words.list_column(np.concatenate(each) if each else np.zeros(0), bounds)], names=["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    if fields:
        parts = [F.coalesce(F.col(f), F.lit("")) for f in fields]
        sizes = [F.octet_length(p).cast("long") for p in parts]
        cuts, at = [], F.lit(0).cast("long")
        for s in sizes:
            cuts.append(at)
            at = at + s
        source = docs.select("doc_id", F.concat(*parts).alias("text"), F.array(*cuts).alias("cuts"))
    else:
        source = docs.select("doc_id", "text", F.lit(None).cast("array<long>").alias("cuts"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")])
    return source.mapInArrow(count, schema)
