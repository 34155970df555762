"""Secrets in texts: fixed forms, and random strings told by how few characters a token of them holds."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The pattern that belongs to the vocabulary file, and the forms of the base kinds.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")

# Lengths of hex digests in use (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]+")
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_DIGEST = re.compile("|".join(f"(?:[0-9a-fA-F]{{{n}}})" for n in DIGEST_LENGTHS))
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: Words, acronyms and numbers joined by separators or by a change of case. Possessive, as no other split of a run of letters could match instead.
_IDENTIFIER = re.compile(r"(?:[+/_=-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[A-Za-z](?![A-Za-z0-9])|[0-9]++(?![A-Za-z])))++[+/_=-]*+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What stands between separators, and digests and UUIDs that are whole parts.
_PART = re.compile(r"[A-Za-z0-9]+")
_WHOLE = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|{_DIGEST.pattern})(?![A-Za-z0-9])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once in each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def is_worded(part: str, path: str, ratio: float) -> bool:
    """Whether a part is an identifier at least half of whose letters stand in words by the tokenizer.

    A word is one token or has more than ``ratio`` characters per token.
    """
    if not _IDENTIFIER.fullmatch(part):
        return False
    letters = words = 0
    for word in _WORD.findall(part):
        tokens = len(encoding(path).encode_ordinary(word))
        letters += len(word)
        words += len(word) if tokens == 1 or len(word) > ratio * tokens else 0
    return 2 * words >= letters


def is_known(run: str, path: str = VOCABULARY, ratio: float = 2.0) -> bool:
    """Whether a run is a digest, a UUID or an identifier made of words and numbers."""
    return bool(_DIGEST.fullmatch(run) or _UUID.fullmatch(run)) or is_worded(run, path, ratio)


class _Taken:
    """What is already taken of a text, as disjoint ranges in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, start, end in sorted(spans, key=lambda x: x[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def _stretches(text: str, start: int, end: int, taken: _Taken, path: str, ratio: float) -> Iterator[tuple[int, int]]:
    """Spans within a run that begin and end with a part that is no word, and whose letters stand mostly in such parts.

    Parts stand between separators. Digests, UUIDs and what is already taken bound a stretch, words only if they outweigh it, so a
    word by chance among random parts doesn't split them.
    """
    parts: list[tuple[int, int, int]] = []
    at = start
    for m in [*_WHOLE.finditer(text, start, end), None]:
        for part in _PART.finditer(text, at, m.start() if m else end):
            s, e = part.span()
            parts.append((s, e, 0 if taken.meets(s, e) else s - e if is_worded(part[0], path, ratio) else e - s))
        if m:
            parts.append((*m.span(), 0))
            at = m.end()
    i = 0
    while i < len(parts):
        total = best = 0
        last = i
        for j in range(i, len(parts)):
            total += parts[j][2]
            if total <= 0 or parts[j][2] == 0:
                break
            if total > best:
                best, last = total, j
        if best:
            yield parts[i][0], parts[last][1]
        i = last + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms: leftmost, not overlapping within a kind, too short ones dropped."""
    found = []
    longest = max(map(len, text.split()), default=0)
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if longest >= 16 and "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if longest >= 32:
        found += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return found


def random_spans(text: str, taken: list[tuple[str, int, int]], path: str, shortest: int, ratio: float) -> list[tuple[str, int, int]]:
    """Spans of runs of at least ``shortest`` characters that hold at most ``ratio`` characters per token.

    Known digests and identifiers are left out, and what meets a span already taken. Where a run as a whole is none, its
    stretches of parts that are no words are tested alike, so a readable path doesn't hide a random string in it.
    """
    if max(map(len, text.split()), default=0) < shortest:
        return []
    found, met = [], _Taken(taken)

    def is_random(start: int, end: int) -> bool:
        if end - start < shortest or met.meets(start, end):
            return False
        part = text[start:end]
        return end - start <= ratio * len(encoding(path).encode_ordinary(part)) and not is_known(part, path, ratio)

    for run in _RUN.finditer(text):
        start, end = run.span()
        if end - start < shortest:
            continue
        places = [(start, end)] if is_random(start, end) else _stretches(text, start, end, met, path, ratio)
        found += [("random", s, e) for s, e in places if is_random(s, e)]
    return found


def spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    shortest: int = 20,
    ratio: float = 2.0,
) -> DataFrame:
    """``(doc_id, spans)`` for each row; a span is ``(kind, start, end)`` in code points, end exclusive, in order of start and kind.

    Kinds: ``assign``, ``access`` and ``hex`` by their forms, ``random`` by the token-efficiency test. A null or empty text has no
    spans. Rows are treated one by one, so repeated rows give equal results and an empty table gives none; other
    columns are not read. ``vocabulary`` is the path of a rank file that every executor can open.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column(1):
                text = cell.as_py() or ""
                base = base_spans(text)
                every = base + random_spans(text, base, vocabulary, shortest, ratio)
                every.sort(key=lambda x: (x[1], KINDS.index(x[0])))
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
