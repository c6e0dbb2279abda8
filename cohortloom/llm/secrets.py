"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

Base spans are the leftmost non-overlapping matches of each kind; those that miss its least length go.
The method adds spans of kind `novel`: a candidate string near a sensitive word is compressed with a
zstandard dictionary primed with common identifiers and the surrounding text; its marginal bytes are
the compressed size less that of nothing. What the context or the dictionary could have produced costs
few bytes; a string that stays incompressible is reported.

The context is the `AROUND` code points on each side. More context could only lower the marginal bytes, so
this bound adds reports of strings that are repeated farther away and never loses one. A string that is
spelled like words or numbers is not measured: one whose runs of lower-case letters (a capital may stand
before them), capitals or digits have `WORDLIKE` characters on average (of random base64 they have 1.8, of
random hex digits 2.1). A secret of small letters alone, or of digits alone, is so found only by `assign`.

A candidate is a maximal run of base64 or URL-safe characters, with all that dots join to it (the parts of
a JWT), where a part has 16 characters or more. It is near a word that it holds, that ends at most `NEAR`
code points before its start, or that starts at most `NEAR` after its end; its own length has no limit.
Each part of 16 or more is measured; if one is novel, the whole candidate is the span. A candidate that
holds the word (and has none near before it) is measured on each side of its first word: the span starts
after the word, or at the candidate's start if the side before is novel, and goes to the candidate's end.
A candidate of which fixed patterns leave no letter or digit is not reported again. A secret farther than
`NEAR` from every word is found by the fixed patterns only.

Offsets count code points, ends are exclusive. Defined results: a null or empty text has no spans;
repeated rows are scanned alike; other columns are ignored, or kept by `redacted`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, ship

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Fixed word lists: what an assignment names, and what makes a context sensitive.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = ("secret", "token", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret", "credential", "bearer", "authorization", "signing_key", "connection_string")
CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.IGNORECASE)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
#: A candidate's characters, and what dots join to it.
JOINED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=~-")
DOTTED = re.compile(r"(?:\.[A-Za-z0-9+/_=~-]+)*")
RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NEAR, AROUND, NOVEL, WORDLIKE = 48, 2048, 0.7, 4
#: Identifiers that often surround secrets in code and settings.
IDENTIFIERS = (
    "def return import from class self None True False const let var function public static void string int bool char async await export default require module "
    "config settings environment production staging development localhost example username user name email host port database url endpoint region bucket version "
    "password passwd secret token api_key apikey access_key private_key client_id client_secret credential bearer authorization signing_key connection_string "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 "
    "your_token_here your_api_key_here changeme placeholder example_key test_key https://www.example.com/ application/json text/html Content-Type Accept-Encoding "
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    out = []
    low = text.lower()
    if any(k in low for k in ASSIGNED):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def marginal_bytes(candidate: str, around: str) -> int:
    """Compressed bytes that the candidate adds beside its surroundings and the identifiers."""
    import zstandard

    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(press.compress(candidate.encode())) - len(press.compress(b""))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the dotted strings that have a part of at least 16 characters, whole, in order; linear in the text."""
    out, done = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if a < done:
            continue
        while a - 1 > done and text[a - 1] == "." and text[a - 2] in JOINED:
            a -= 1
            while a > done and text[a - 1] in JOINED:
                a -= 1
        done = DOTTED.match(text, b).end()
        out.append((a, done))
    return out


def _novel(text: str, a: int, b: int, base: list[tuple[int, int, str]]) -> bool:
    """Whether a part of text[a:b] is novel and the fixed patterns leave a letter or digit of text[a:b]."""
    at, left = a, []
    for s, e, _ in sorted(x for x in base if x[0] < b and a < x[1]):
        left.append(text[at : max(at, s)])
        at = max(at, e)
    if not any(x.isalnum() for piece in [*left, text[at:b]] for x in piece):
        return False
    for m in CANDIDATE.finditer(text, a, b):
        word = m[0]
        runs = [len(x) for x in RUN.findall(word)]
        if sum(runs) >= WORDLIKE * len(runs):
            continue
        around = text[max(0, m.start() - AROUND) : m.start()] + text[m.end() : m.end() + AROUND]
        if marginal_bytes(word, around) >= NOVEL * len(word):
            return True
    return False


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(k in low for k in SENSITIVE):
        return []
    words = [c.span() for c in CONTEXT.finditer(text)]
    out, i = [], 0
    for a, b in candidates(text):
        while i < len(words) and words[i][1] <= a:
            i += 1
        #: Word i is the first that ends behind the candidate's start; words are made of its characters, so it is inside or behind.
        if i and a - words[i - 1][1] <= NEAR:
            if _novel(text, a, b, base):
                out.append((a, b, "novel"))
        elif i < len(words) and words[i][0] < b:
            s, e = words[i]
            if _novel(text, a, s, base):
                out.append((a, b, "novel"))
            elif _novel(text, e, b, base):
                out.append((e, b, "novel"))
        elif i < len(words) and words[i][0] - b <= NEAR and _novel(text, a, b, base):
            out.append((a, b, "novel"))
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """All spans by start, then kind in the order of KINDS."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
        digest, every = [], []
        for text in batch.column("text").to_pylist():
            found = spans(text)
            base = [s for s in found if s[2] != "novel"]
            for k, v in n.items():
                v.append(sum(s[2] == k for s in base))
            digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            every.append(_joined(found))
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in n.values()), pa.array(digest, pa.string()), pa.array(every, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row."""
    return id_and_text(docs).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans(text):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with secrets replaced in `text`, and n_chars, where there is one, set to the new length; null texts stay null."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            old = batch.column("text").to_pylist()
            new = [None if t is None else redact(t, mark) for t in old]
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in cols:
                size = cols["n_chars"].to_pylist()
                cols["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(size, old, new, strict=True)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)
