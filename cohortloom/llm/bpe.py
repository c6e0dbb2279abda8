"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the last four bytes before ASCII white space hits a target, so
equal passages in different documents give equal chunks whatever stands before them. A chunk is
encoded once by each worker and then reused for all documents that the worker reads (a bounded cache of
chunks, and within new chunks one of words, the smallest chunks there are): of the chunks of a corpus without
copies most are new, so a table of all chunks would shuffle more than it saves, while most words are not. With
the settings of `KNOWN` white space always ends a pre-token, so such joins agree without repair; a
word longer than `LONG` has no such place, is cut at a fixed length and its joins are repaired: the last
pre-tokens before the join, which the text after it can change, are encoded again with the next
piece until those before them can change no more.

The ids equal those of the library for the whole text, and the decoded text is made from the ids. The
vocabulary file is a parameter and is read by each worker; nothing is trained. A file with other settings
than `KNOWN` is encoded and decoded by the library, whole texts at a time.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows are
encoded alike; other columns are ignored or, by `with_tokens`, kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, ship

CHUNK_BITS, LONG, CARRY = 6, 512, 3
CHUNKS, WORDS = 20_000, 250_000
BATCH = 256
#: The settings of a tokenizer file for which chunks may be cut at white space and simple words taken apart.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "decoder": None, "end_of_word_suffix": "</w>",
    "added": {("<|startoftext|>", False, False, False, False), ("<|endoftext|>", False, False, False, False)},
}


def settings(path: str) -> dict:
    """What KNOWN holds, of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    added = {(t["content"], t["single_word"], t["lstrip"], t["rstrip"], t["normalized"]) for t in d["added_tokens"]}
    return {k: d[k] for k in ("normalizer", "pre_tokenizer", "post_processor", "decoder")} | {"end_of_word_suffix": d["model"].get("end_of_word_suffix"), "added": added}


#: Words of ASCII and composed Latin-1 letters, digits and ASCII marks but the apostrophe; their pre-tokens.
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
SPLIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes whole texts; holds what this worker has encoded so far, up to the two bounds."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.names: dict[int, str] = {i: t for t, i in self.model.get_vocab(with_added_tokens=True).items()}
        self.special = set(self.model.get_added_tokens_decoder())
        self.known = settings(path) == KNOWN
        pre = self.model.pre_tokenizer
        #: How the byte-level step spells the letters of simple words.
        self.spelled = {ord(c): pre.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()} if self.known else {}
        #: Ids of chunks, of words (the smallest chunks), of old ones, and of the pre-tokens of simple words.
        self.chunks: dict[bytes, bytes | None] = {}
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def decoded(self, raw: bytes) -> str:
        """The library's decode of the ids, special tokens included."""
        ids = np.frombuffer(raw, "<u4").tolist()
        if not self.known:
            return self.model.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, ids))  # no decoder: the tokens as they are

    def long_word(self, word: str, piece: int = LONG) -> list[int]:
        """Pieces with repaired joins; exactly the ids of the whole word."""
        if len(word) <= 2 * piece:
            return self.model.encode(word, add_special_tokens=False).ids
        ids: list[int] = []
        window, at = word[:piece], piece
        while at < len(word):
            e = self.model.encode(window, add_special_tokens=False)
            at_edge = [x[0] >= y[1] for x, y in zip(e.offsets[1:], e.offsets, strict=False)] + [True]  # a character can make two pre-tokens
            ends = [k for k, t in enumerate(e.tokens) if at_edge[k] and (t.endswith("</w>") or e.ids[k] in self.special)]
            if len(ends) > CARRY:
                keep = ends[-CARRY - 1] + 1
                ids += e.ids[:keep]
                window = window[e.offsets[keep][0] :]
            step = max(piece, len(window))  # a window without a safe place doubles
            window, at = window + word[at : at + step], at + step
        return ids + self.model.encode(window, add_special_tokens=False).ids

    def simple_word(self, text: str) -> bytes:
        """A word whose normal form and pre-tokens are plain: the library's model encodes each new pre-token."""
        out = []
        for p in SPLIT.findall(text.lower()):
            if (x := self.pieces.get(p)) is None:
                x = self.pieces[p] = array("I", [t.id for t in self.model.model.tokenize(p.translate(self.spelled))]).tobytes()
            out.append(x)
        return b"".join(out)

    def learn(self, words: set[bytes]) -> None:
        """Have all the words in self.words."""
        if len(self.words) > WORDS:
            self.old, self.words = self.words, {}
        if len(self.pieces) > WORDS:
            self.pieces = {}
        hard = []
        for w in words - self.words.keys():
            if (x := self.old.get(w)) is None:
                text = w.decode("utf-8", "surrogatepass")
                if len(text) > 2 * LONG:
                    x = array("I", self.long_word(text)).tobytes()
                elif SIMPLE.fullmatch(text) and "<|" not in text:
                    x = self.simple_word(text)
                else:
                    hard.append((w, text))
                    continue
            self.words[w] = x
        for a in range(0, len(hard), 2000):
            part = hard[a : a + 2000]
            for (w, _), e in zip(part, self.model.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                self.words[w] = array("I", e.ids).tobytes()

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of each text."""
        if not self.known:
            for t in texts:
                raw = array("I", self.model.encode(t, add_special_tokens=False).ids).tobytes()
                yield raw, self.decoded(raw)
            return
        if len(self.chunks) > CHUNKS:
            self.chunks = {}
        chunks, chunked, words = self.chunks, [], set()
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass")
            parts = [raw[a:b] for a, b in cuts(raw)]
            chunked.append(parts)
            for p in parts:
                if p not in chunks:
                    chunks[p] = None
                    words.update(p.split())
        self.learn(words)
        get = self.words.__getitem__
        for parts in chunked:
            out = []
            for p in parts:
                if (x := chunks[p]) is None:
                    x = chunks[p] = b"".join([get(w) for w in p.split()])
                out.append(x)
            raw = b"".join(out)
            yield raw, self.decoded(raw)


def cuts(raw: bytes, bits: int = CHUNK_BITS) -> list[tuple[int, int]]:
    """Where to cut: white space whose four bytes before it hash to a multiple of 2^bits."""
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[at >= 4]
    if not len(at):
        return [(0, len(raw))] if raw else []
    d = data.astype(np.uint32)
    h = ((d[at - 1] * np.uint32(0x01000193) + d[at - 2]) * np.uint32(0x01000193) + d[at - 3]) * np.uint32(0x01000193) + d[at - 4]
    h *= np.uint32(0x9E3779B1)
    places = [0, *at[(h >> np.uint32(32 - bits)) == 0].tolist(), len(raw)]
    return list(zip(places, places[1:], strict=False))


def encoder(path: str | None) -> Encoder:
    """This worker's encoder, with what it has encoded so far."""
    path = vocabulary_path(path)
    held = sys.__dict__.setdefault("_cohortloom_bpe", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                n, ids, out = [], [], []
                for raw, decoded in enc.texts(batch.column("text").to_pylist()):
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    out.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    run, schema = _digests(path)
    return id_and_text(docs).mapInArrow(run, schema)


def with_tokens(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "token_ids", decoded: str = "decoded_text", n_tokens: str = "n_tokens") -> DataFrame:
    """docs with three more columns: the ids (array<int>), their decoded text and their number."""
    ship(docs.sparkSession)

    def run(batches):
        enc = encoder(path)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                both = list(enc.texts([t or "" for t in batch.column(text).to_pylist()]))
                lists = pa.array([np.frombuffer(x[0], "<u4").astype(np.int32) for x in both], pa.list_(pa.int32()))
                cols = [*batch.columns, lists, pa.array([x[1] for x in both], pa.string()), pa.array([len(x[0]) // 4 for x in both], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, ids, decoded, n_tokens])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

    clash = {ids, decoded, n_tokens} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}; name the new ones otherwise")
    schema = StructType([*docs.schema.fields]).add(ids, ArrayType(IntegerType())).add(decoded, StringType()).add(n_tokens, LongType())
    return docs.mapInArrow(run, schema)


def decode(ids, path: str | None = None) -> str:
    """The library's decode(ids, skip_special_tokens=False)."""
    return encoder(path).decoded(array("I", [int(i) for i in ids]).tobytes())


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens."""
    return digests(docs, path).select("doc_id", F.col("n_tokens"))
