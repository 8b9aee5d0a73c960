"""BPE encoding and decoding over a table of distinct words.

1. Texts are normalised and split into words in Arrow batches as the tokenizer does it (NFC, lower case letter
   by letter, its pattern; the strings of special tokens are cut out first), each text once. A run of texts of about
   CHUNK words is a row of a written table: its distinct words, and the place of every word of its texts in them.
2. Chunks send their distinct words to tasks dealt by the word's hash; there each distinct word of all texts is encoded
   once by the tokenizers library. A word comes from a chunk once, so a frequent one is no larger than any other.
3. The ids go back to the chunks that asked, a join by chunk, and are put at the words' places.
4. Ids are decoded by the id-to-piece table of the vocabulary, pieces joined by one space, which is what the
   library does for this tokenizer without a decoder. The table is as small as the vocabulary, so it is broadcast.

Defined cases: a null or empty text has no ids and decodes to an empty string; repeated rows are encoded
each; a null id is kept; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rondo.llm import bytescan as bs
from rondo.llm.common import BIG_ROWS, cut, map_arrow_all, parts_for

#: The tokenizer's split pattern, for ASCII and for the Latin texts of _PLAIN, whose letters and numbers are listed.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_LETTERS, _NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u0233", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
LATIN_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")
#: Words in a chunk, about.
CHUNK = 1 << 22
#: Words sent to a task, about: its table of distinct words is no larger.
TASK_WORDS = 400_000


#: Outside these, Unicode tables of different versions may differ: the library's own normaliser and splitter serve.
_PLAIN = re.compile("[\x00-\u0233\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")


class Splitter:
    """The words of a text; a special token's string is a word of its own."""

    def __init__(self, encoder: Tokenizer):
        self.encoder = encoder

    def __call__(self, text: str) -> list[str]:
        if "<|" in text and _SPECIAL.search(text):
            return [w for k, part in enumerate(_SPECIAL.split(text)) for w in ([part] if k % 2 else self._split(part))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_PATTERN.findall(text.lower())
        if not _PLAIN.fullmatch(text):
            text = self.encoder.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.encoder.pre_tokenizer.pre_tokenize_str(text)]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return LATIN_PATTERN.findall(text.lower())


def _texts(batch: pa.RecordBatch, k: int) -> Iterator[str]:
    for x in batch.column(k):
        yield x.as_py() or ""


def _encoder(vocabulary: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    encoder = Tokenizer.from_str(vocabulary)
    encoder.no_truncation()
    encoder.no_padding()
    return encoder


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9)


def _squeezed(raw: bytes) -> bytes:
    """By zstandard, or as it is if it is short: a message of one word is no longer than the word."""
    return b"z" + _compressor().compress(raw) if len(raw) >= 256 else b"p" + raw


def _whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"z" else data[1:]


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32 by zstandard: a byte for each small one, and planes of bytes, almost all zeros, for the others."""
    small = np.minimum(x, _SMALL).astype(np.uint8)
    rest = (x[small == _SMALL] - _SMALL).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return _squeezed(len(x).to_bytes(4, "little") + small.tobytes() + rest.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = _whole(data)
    n = int.from_bytes(raw[:4], "little")
    small = np.frombuffer(raw, np.uint8, n, 4)
    out = small.astype(np.uint32)
    out[small == _SMALL] += np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=4 + n).reshape(4, -1).T).view("<u4").reshape(-1)
    return out


_SMALL = 240


def _pack_words(words: list[str]) -> bytes:
    """No word holds a line feed, which ends every word of the tokenizer."""
    return _squeezed("\n".join(words).encode())


def _unpack_words(data: bytes) -> list[str]:
    return _whole(data).decode().split("\n")


def chunks(docs: DataFrame, vocabulary: Broadcast, keep: tuple[str, ...], size: int) -> DataFrame:
    """(chunk, rows, sizes, words, n_words, places): runs of texts; ``rows`` has the columns ``keep`` of each text, ``sizes`` its words."""
    own = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        split, number = Splitter(_encoder(vocabulary.value)), TaskContext.get().partitionId() << 32
        place, rows, sizes, places = defaultdict(count().__next__), [], [], []

        def row() -> dict:
            at = np.concatenate(places)
            often = np.argsort(-np.bincount(at, minlength=len(place)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often))
            known = list(place)
            words = [known[i] for i in often.tolist()]
            return {"chunk": [number], "rows": pa.array([[x for part in rows for x in part.to_pylist()]]), "sizes": [sizes], "words": [_pack_words(words)], "n_words": [len(words)], "places": [_pack(rank[at])]}

        total = 0
        for batch in batches:
            begin = 0
            for i, text in enumerate(_texts(batch, len(keep)), 1):
                words = split(text)
                places.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
                sizes.append(len(words))
                total += len(words)
                if total >= size or i == len(batch):
                    part = batch.slice(begin, i - begin)
                    rows.append(pa.StructArray.from_arrays([part.column(k) for k in range(len(keep))], names=list(keep)))
                    begin = i
                if total >= size:
                    yield row()
                    number, total = number + 1, 0
                    place, rows, sizes, places = defaultdict(count().__next__), [], [], []
        if sizes:
            yield row()

    kinds = ", ".join(f"`{n}`: {t}" for n, t in own.dtypes if n != "text")
    return cut(map_arrow_all(own, run, f"chunk long, rows array<struct<{kinds}>>, sizes array<int>, words binary, n_words long, places binary"), **BIG_ROWS)


def word_ids(table: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """(chunk, at, many, ids): for words of a chunk, by their place ``at`` in its table, how many ids each has and these."""
    spark = table.sparkSession
    parts = parts_for(spark, table.agg(F.sum("n_words")).head()[0] or 0, TASK_WORDS)
    blocks = 2 * parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _unpack_words(packed)
                (_, data, offs), *_ = bs.slices(pa.array(words), 1 << 62)
                block = (bs.span_hash(data, offs[:-1], offs[1:]) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                bound = np.flatnonzero(np.append(True, np.diff(block[order]) > 0))  # only blocks that the chunk has words of
                parts_ = np.split(order, bound[1:])
                yield {
                    "block": block[order[bound]], "chunk": np.full(len(bound), chunk), "at": [_pack(np.diff(x, prepend=0)) for x in parts_],  # ascending
                    "words": [_pack_words([words[i] for i in x.tolist()]) for x in parts_],
                }

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = _encoder(vocabulary.value)
        kind = _id_type(encoder)
        known: dict[str, bytes] = {}
        for batch in batches:
            out = {"chunk": batch.column(0), "at": batch.column(1), "many": [], "ids": []}
            for packed in batch.column(2).to_pylist():
                words = _unpack_words(packed)
                new = [w for w in words if w not in known]
                known.update((w, np.array(x.ids, kind).tobytes()) for w, x in zip(new, encoder.encode_batch(new, add_special_tokens=False), strict=True))
                ids = [known[w] for w in words]
                out["many"].append(_pack(np.fromiter(map(len, ids), np.uint32, len(ids)) // kind.itemsize))
                out["ids"].append(_squeezed(b"".join(ids)))
            yield out

    asked = map_arrow_all(table.where("n_words > 0").select("chunk", "words"), ask, "block long, chunk long, at binary, words binary")
    return map_arrow_all(asked.repartition(parts, "block").select("chunk", "at", "words"), encode, "chunk long, at binary, many binary, ids binary")


def _id_type(encoder: Tokenizer) -> np.dtype:
    return np.dtype(np.uint16 if encoder.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32)


#: Ids in a batch of results, about.
_IDS = 200_000


def encoded(docs: DataFrame, path: str, finish: Callable[[list[int], list[str], list[str]], dict], schema: str, chunk: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """``finish(ids, id_text, pieces)`` makes a dictionary of result columns from the ids of each text; columns ``keep`` stay."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:  # the driver's own file: the path is a parameter
        vocabulary = spark.sparkContext.broadcast(f.read())  # the tokenizer's file
    encoder = _encoder(vocabulary.value)
    kind = _id_type(encoder)
    pieces = spark.sparkContext.broadcast([encoder.id_to_token(i) or "" for i in range(encoder.get_vocab_size(with_added_tokens=True))])
    keep = tuple(dict.fromkeys(("doc_id", *keep)))
    table = chunks(docs, vocabulary, keep, chunk)
    found = word_ids(table, vocabulary).groupBy("chunk").agg(F.collect_list(F.struct("at", "many", "ids")).alias("found"))
    both = table.join(found.hint("shuffle_hash"), "chunk", "left").select("rows", "sizes", "places", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        piece = pieces.value
        number = [str(i) for i in range(len(piece))]
        for batch in batches:
            for k in range(len(batch)):
                rows, sizes = batch.column(0)[k].values, np.array(batch.column(1)[k].as_py(), np.int64)
                answers = batch.column(3)[k].as_py() or []
                joined = lambda f, name: np.concatenate([np.zeros(0, np.int64), *(f(x[name]) for x in answers)])  # noqa: E731, B023
                at, many = joined(lambda x: np.cumsum(_unpack(x), dtype=np.int64), "at").astype(np.int64), joined(_unpack, "many").astype(np.int64)
                flat = np.frombuffer(b"".join(_whole(x["ids"]) for x in answers), kind)
                first, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                first[at], length[at] = np.cumsum(many) - many, many
                places = _unpack(batch.column(2)[k].as_py())
                bound = np.append(0, np.cumsum(sizes))
                begin = 0
                while begin < len(sizes):  # whole texts of some _IDS words
                    end = max(begin + 1, int(np.searchsorted(bound, bound[begin] + _IDS, "right")) - 1)
                    word = places[bound[begin] : bound[end]]
                    stop = np.cumsum(length[word])
                    ids = flat[np.repeat(first[word] - (stop - length[word]), length[word]) + np.arange(stop[-1] if len(stop) else 0)].tolist()
                    edge = np.append(0, stop)[bound[begin : end + 1] - bound[begin]].tolist()
                    out = [finish(ids[a:b], number, piece) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                    part = rows.slice(begin, end - begin)
                    yield {name: part.field(name) for name in keep} | {name: [x[name] for x in out] for name in out[0]}
                    begin = end

    return map_arrow_all(both, run, schema)


def text_digest(ids: list[int], number: list[str], piece: list[str]) -> dict:
    return {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest(),
        "decoded_sha256": hashlib.sha256(" ".join([piece[i] for i in ids]).encode()).hexdigest(),
    }


def digest(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """op9: (doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return encoded(docs, path, text_digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", chunk)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded): the ids themselves and the decoded text."""
    return encoded(docs, path, lambda ids, _, piece: {"ids": ids, "decoded": " ".join([piece[i] for i in ids])}, "doc_id long, ids array<int>, decoded string", chunk)
