"""Secrets in texts: patterns of known forms, and strings that a compressor primed with their surroundings cannot shorten.

Novelty: a candidate is a run of 12 or more key characters with a letter and a digit that stands within `reach` characters
of a sensitive word, before or after it; any value of 6 or more that a sensitive name is set to; or a long line of a private
key block. A zstandard compressor gets, as its raw dictionary, common identifiers, those that the corpus itself uses most (see
learnt_identifiers) and the text around the candidate, without it and its copies; the bytes that the candidate then adds, divided by its length, are its novelty. Names, paths and known
words add few bytes; random keys add about as many as they have, and are reported from `threshold` on, with all their copies
in the text. One such line reports its whole key block. In running text words unknown to the compressor are as new to it as
keys, so there the digit and the length are asked for.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import over_batches, texts_of

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "novel")

# The base patterns, with the least length of the part that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api_?key|private|credential|bearer|auth|signature|access_?key|pwd", re.ASCII | re.IGNORECASE)

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[+/_=0-9-]*[A-Za-z])(?=[+/_=A-Za-z-]*[0-9])[A-Za-z0-9+/_=-]{12,}")

#: A value that a name with a sensitive word is set to.
SET_TO = re.compile(
    r"""(?:passw(?:or)?d|passphrase|secret|token|api_?key|private_?key|credentials?|bearer|auth|authorization|signature|access_?key|pwd)"""
    r"""(?:[_-][A-Za-z0-9_-]{1,64}+|Key|Id|Value)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""",
    re.ASCII | re.IGNORECASE,
)
#: The head of a key block; its lines where no tail follows; a line that is judged.
BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
LINES = re.compile(r"(?:(?:\s|\\[rn])*[A-Za-z0-9+/=_-]{16,})*")
LINE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")

#: Identifiers that code and configuration share.
IDENTIFIERS = (
    "username user_name password passwd secret_key access_key api_key apikey token access_token refresh_token bearer authorization "
    "client_id client_secret private_key public_key signature certificate credential connection_string database_url hostname localhost "
    "function return import class const static public void string integer boolean default example placeholder changeme your_token_here "
    "https://www. http://localhost:8080 .example.com version=1.0.0 -----BEGIN RSA PRIVATE KEY----- abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 application/json content-type utf-8 sha256 sha1 md5 base64 aws_access_key_id "
    "aws_secret_access_key config settings environment production staging development test_user admin root guest"
).encode()

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns; matches of one kind do not overlap, and one that fails its length is dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


#: A name as code and configuration have it: words or numbers joined by _, - or /, an inner capital, or a digit; and names that
#: are rather keys, because a part of them mixes letters and digits or is very long.
_NAME = r"(?<![A-Za-z0-9_/-])(?=[A-Za-z0-9]*[_/-]|[A-Za-z]*[0-9]|[a-z]+[A-Z])[A-Za-z_][A-Za-z0-9_/-]{3,39}(?![A-Za-z0-9_/-])"
_KEYLIKE = r"(?:^|[_/-])(?:(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{8,}|[A-Za-z0-9]{20,})(?:[_/-]|$)"


def learnt_identifiers(docs: DataFrame, max_bytes: int = 8_192, id_col: str = "doc_id", text_col: str = "text") -> bytes:
    """The names that most documents use, up to max_bytes of them, the commonest last, where a dictionary is nearest.

    All of all texts is counted, by DataFrame functions with partial sums in every task. What looks like a key, and whatever a
    sensitive name is set to anywhere in the corpus, is left out, so that a secret that stands in a thousand copies of a
    document does not excuse itself. A name that only one document has is not taken; null texts are empty; an empty table
    gives an empty dictionary.
    """
    texts = texts_of(docs, id_col, text_col).select("text")
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_NAME), F.lit(0)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1").where(~F.col("word").rlike(_KEYLIKE))
    values = texts.where(F.col("text").rlike(_MAYBE)).select(F.explode(F.regexp_extract_all("text", F.lit("(?i)" + SET_TO.pattern), F.lit(1))).alias("word")).distinct()
    # no name is shorter than 4 letters, so this many fill the dictionary
    most = counts.join(values, "word", "left_anti").orderBy(F.col("n").desc(), "word").limit(max_bytes // 5).collect()
    out, size = [], 0
    for row in most:
        size += len(row["word"]) + 1
        if size > max_bytes:
            break
        out.append(row["word"])
    return " ".join(reversed(out)).encode()


def novelty(text: str, start: int, end: int, around: int, copies: bool = True, known: bytes = b"") -> float:
    """Bytes that text[start:end] adds to its surroundings, with or without its copies there, and the identifiers, per byte of its own."""
    told = text[start:end]
    value = told.encode()
    context = (text[max(0, start - around) : start] + "\n" + text[end : end + around])
    context = (context if copies else context.replace(told, "\n")).encode("utf-8", "surrogatepass")
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + known + b"\n" + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(press.compress(value)) - len(press.compress(b""))) / len(value)


def key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of what stands in private key blocks: up to the tail, or all lines of key characters if there is none."""
    heads, found, tail = list(BLOCK.finditer(text)), [], 0
    for k, m in enumerate(heads):
        if 0 <= tail < m.end():
            tail = text.find("-----END", m.end())
        upto = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        end = tail if 0 <= tail < upto else LINES.match(text, m.end()).end()
        found.append((m.end(), end))
    return found


class _Taken:
    """Stretches of a text that are taken, joined where they touch, for a search by place."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect.bisect_left(self.starts, b) - 1
        return k < 0 or self.ends[k] <= a


def _copies(text: str, values: set[str]) -> Iterator[tuple[int, int]]:
    """Where the values stand in text, in one pass over it; copies of one value do not overlap."""
    automaton = ahocorasick.Automaton()
    for value in values:
        automaton.add_word(value, len(value))
    automaton.make_automaton()
    last: dict[str, int] = {}
    for end, size in automaton.iter(text):
        start, name = end + 1 - size, text[end + 1 - size : end + 1]
        if last.get(name, 0) <= start:
            last[name] = end + 1
            yield start, end + 1


def secret_spans(text: str, threshold: float = 0.7, reach: int = 48, around: int = 2048, known: bytes = b"") -> list[Span]:
    """base_spans() and, where they leave room, novel strings; a key block with a novel line is one span.

    Linear in the text: each candidate costs a search among the sorted spans and a compression of `around` characters.
    """
    found = base_spans(text)
    blocks = []
    for a, b in key_blocks(text):
        lines = [m.span() for m in LINE.finditer(text, a, b)]
        if any(novelty(text, *x, around, False, known) >= threshold for x in lines):
            blocks.append((a + len(text[a:b]) - len(text[a:b].lstrip()), 3, a + len(text[a:b].rstrip())))
    taken = _Taken(found + blocks)
    near = lambda a, b: SENSITIVE.search(text, max(0, a - reach), a) or SENSITIVE.search(text, b, b + reach)
    spans = [m.span(1) for m in SET_TO.finditer(text)]
    spans += [m.span() for m in CANDIDATE.finditer(text) if near(*m.span())]
    novel, values = [], set()
    for a, b in spans:
        if not taken.free(a, b) or novelty(text, a, b, around, False, known) < threshold:
            continue
        novel.append((a, b))
        if CANDIDATE.fullmatch(text[a:b]):
            values.add(text[a:b])
    if values:
        novel += [x for x in _copies(text, values) if taken.free(*x)]
    kept: list[Span] = []
    for a, b in sorted(set(novel)):
        if kept and a < kept[-1][2]:
            kept[-1] = (kept[-1][0], 3, max(b, kept[-1][2]))
        else:
            kept.append((a, 3, b))
    return sorted(found + blocks + kept)


def joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def redacted(text: str, spans: list[Span], mark: str) -> str:
    """text with each stretch that spans cover replaced by mark."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


#: What a text must hold for any span, for the vectorised test that spares the others.
_MAYBE = r"(?i)passw|passphrase|secret|token|api_?key|private|credential|bearer|auth|signature|access_?key|pwd|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"


def _scan(column: pa.Array, threshold: float, known: bytes) -> list[list[Span]]:
    """The spans of each text; only texts that the vectorised test lets through become Python strings."""
    hits = pc.match_substring_regex(column, _MAYBE)
    found = iter(column.filter(hits).to_pylist())
    return [secret_spans(next(found), threshold, known=known) if hit else [] for hit in hits.to_pylist()]


def find_secrets(docs: DataFrame, threshold: float = 0.7, known: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) per row: spans as arrays of (kind, start, end) in code points, end exclusive, by start and kind.

    Scan-local over whole texts; known: identifiers of the corpus for the dictionary, learnt_identifiers(). A null or empty text
    has no spans; a null doc_id stays null; rows that repeat each give a row; an empty table gives no rows; other columns are
    not read. base holds the pattern matches alone, spans those and the novel strings.
    """
    one = "array<struct<kind:string,start:int,end:int>>"

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            told = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in rows], kind)
            found = _scan(batch.column(1), threshold, known)
            return pa.RecordBatch.from_arrays([batch.column(0), told([[s for s in spans if s[1] < 3] for spans in found]), told(found)], ["doc_id", "base", "spans"])

        return apply

    return over_batches(texts_of(docs, id_col, text_col), make, f"doc_id long, base {one}, spans {one}")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", threshold: float = 0.7, known: bytes = b"", text_col: str = "text") -> DataFrame:
    """docs with every span of a secret replaced by mark in text_col; all rows and columns stay, a null text stays null.

    Spans are those of find_secrets(). Rows that repeat are changed alike; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(at)
            spans = _scan(pc.fill_null(column, ""), threshold, known)
            if not any(spans):
                return batch
            texts = [redacted(x.as_py(), s, mark) if s else x.as_py() for x, s in zip(column, spans, strict=True)]
            return batch.set_column(at, batch.schema.field(at), pa.array(texts, column.type))

        return apply

    return over_batches(docs, make, docs.schema)
