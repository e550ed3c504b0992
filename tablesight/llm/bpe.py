"""Byte-level BPE of whole texts through a table of distinct words, and back.

1. **Split.** Tasks split texts into words as the tokenizer does. The documents of a block, up to
   ``BLOCK_WORDS`` words, number their distinct words; a document becomes the numbers of its words. Both
   are stored in one table, bucketed by block. A block's words are dealt to parts by checksum, so a word
   is in one part everywhere, and words travel as arrays.
2. **Encode.** Parts are exchanged once. A part is a slice of the distinct-word table: each of its words is
   encoded by the library once, alone, since the ids of a text are those of its words in a row. The ids go
   to every block that holds the word, as arrays.
3. **Join back.** Blocks and ids are cogrouped, and a document takes the ids of its words by position.
4. **Decode.** Ids are joined with the vocabulary's pieces by id, once per distinct word of a block, and a
   document takes the bytes of its words. Pieces are as many as the vocabulary, whatever the corpus.

A word occurs once per block, so no word makes a hot key however often it is written, and nothing is
collected per word. What is exchanged are distinct words per block; documents are not shuffled, as they
lie in their block's bucket.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.plans.shared import scratch_folder

VOCABULARY = "byte_bpe_50k"
#: Words of a block, and parts of the distinct words for each shuffle partition.
BLOCK_WORDS, PARTS = 1 << 22, 4
#: Up to here the character classes of ``regex`` and of the tokenizer are the same.
COMMON = "԰"
#: Characters that stand in for one of another class while a text is split: a letter, a digit, a sign, a blank.
STAND_INS = ("a", "1", "!", "\t")


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    """The library's tokenizer, loaded once in a task."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


class Splitter:
    """Splits texts into the words that the tokenizer encodes one by one.

    The pattern runs in ``regex``, which is six times as fast as the library. Both know different
    versions of Unicode, so the library is asked for the class of every character beyond ``COMMON`` when it
    is first met; where ``regex`` sees another class, a stand-in takes its place while the text is split.
    Added tokens are words of their own.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex

        tokenizer = _tokenizer(vocabulary)
        self.pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.rare = regex.compile(f"[^\\x00-{COMMON}]").findall
        self.kind = regex.compile(r"(\p{L})|(\p{N})|([^\s\p{L}\p{N}])|(\s)").fullmatch
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.known: set[str] = set()
        self.swaps: dict[int, str] = {}

    def _learn(self, characters: set[str]) -> None:
        for c in characters:
            kind = next((i for i, s in enumerate(STAND_INS[:3]) if len(self.pieces(s + c)) == 1), 3)
            if self.kind(c).lastindex != kind + 1:
                self.swaps[ord(c)] = STAND_INS[kind]
        self.known |= characters

    def _section(self, text: str) -> list[str]:
        if not text.isascii():
            new = set(self.rare(text)) - self.known
            if new:
                self._learn(new)
            if self.swaps:
                swapped = text.translate(self.swaps)
                if swapped != text:
                    out, at = [], 0
                    for word in self.words(swapped):
                        out.append(text[at : at + len(word)])
                        at += len(word)
                    return out
        return self.words(text)

    def __call__(self, text: str) -> list[str]:
        sections = self.added(text)
        if len(sections) == 1:
            return self._section(text)
        return [w for i, s in enumerate(sections) for w in ([s] if i % 2 else self._section(s))]


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


#: A row is a document (its words' numbers in ``codes``) or, with a part, the block's words of that part, in order and
#: written without gaps, with their numbers and lengths.
SPLIT = "block long, part int, doc_id long, codes array<int>, words string, sizes array<int>"


def _split(vocabulary: str, parts: int, block_words: int):
    names = ["block", "part", "doc_id", "codes", "words", "sizes"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def closed(block: int, numbers: _Numbers) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[str]] = {}
        for word in numbers:
            by_part.setdefault(zlib.crc32(word.encode("utf-8", "surrogatepass")) % parts, []).append(word)
        rows = []
        for part, words in by_part.items():
            words.sort()  # neighbours share their beginnings, so the exchange takes little
            rows.append((block, part, None, [numbers[w] for w in words], "".join(words), [len(w) for w in words]))
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        split = Splitter(vocabulary)
        block, numbers, size = TaskContext.get().partitionId() << 32, _Numbers(), 0
        for rows in batches:
            held, waiting = [], 0
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
                words = split(text.as_py() or "")
                codes = np.fromiter((numbers[w] for w in words), np.int32, len(words))
                held.append((block, None, doc, codes, None, None))
                size, waiting = size + len(words), waiting + len(words)
                if size >= block_words:
                    yield batch(held)
                    yield from closed(block, numbers)
                    block, numbers, size, held, waiting = block + 1, _Numbers(), 0, [], 0
                elif waiting >= 1 << 19:
                    yield batch(held)
                    held, waiting = [], 0
            if held:
                yield batch(held)
        yield from closed(block, numbers)

    return run


def _bucketed(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` written once to the shared folder, bucketed by block, and read back."""
    spark, name = rows.sparkSession, f"bpe_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("compression", "zstd").option("path", scratch_folder(spark, "bpe-blocks"))
    writer.bucketBy(parts, "block").saveAsTable(name)
    return spark.table(name)


#: Of a block's words of one part, in their order: how many ids each has, and these ids in a row, of 2 or 4 bytes.
ENCODED = "home long, slice int, size array<int>, ids binary"


def _id_type(n_pieces: int) -> str:
    return "<u2" if n_pieces <= 1 << 16 else "<u4"


def _encode(vocabulary: str, kind: str):
    """Encodes one part of the distinct-word table and deals the ids to the blocks that hold the words."""

    def run(part: pa.Table) -> pa.Table:
        import numpy as np

        own, words = [], []
        for joined, sizes in zip(part["words"].to_pylist(), part["sizes"]):
            ends = np.cumsum(sizes.values.to_numpy()).tolist()
            own.append(len(ends))
            words += [joined[a:b] for a, b in zip([0, *ends], ends)]
        table = pa.array(words, pa.string()).dictionary_encode()
        found = _tokenizer(vocabulary).encode_batch_fast(table.dictionary.to_pylist(), add_special_tokens=False)
        ids = pa.array([x.ids for x in found], pa.list_(pa.int32())).take(table.indices)
        bounds = [0, *np.cumsum(own).tolist()]
        of_block = [ids.slice(a, b - a) for a, b in zip(bounds, bounds[1:])]
        size = pa.array([x.value_lengths() for x in of_block], pa.list_(pa.int32()))
        flat = pa.array([x.flatten().to_numpy().astype(kind).tobytes() for x in of_block], pa.binary())
        return pa.table([part["block"], part["part"], size, flat], ["home", "slice", "size", "ids"])

    return run


def piece_list(vocabulary: str = VOCABULARY) -> list[bytes]:
    """The bytes that each id of the vocabulary stands for, by id."""
    tokenizer = _tokenizer(vocabulary)
    added = tokenizer.get_added_tokens_decoder()
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that are written as themselves, in byte-level BPE
    others = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}

    def raw(text: str) -> bytes:
        return bytes(byte[c] for c in text) if all(c in byte for c in text) else text.encode()

    names = {i: token for token, i in tokenizer.get_vocab().items()} | {i: t.content for i, t in added.items()}
    return [raw(names[i]) if i in names else b"" for i in range(max(names) + 1)]


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of ``rows`` (doc_id, ids) from any source: doc_id and text, by a join of ids with pieces.

    The pieces are as many as the vocabulary has ids and are broadcast. Ids beyond it stand for nothing;
    bytes that are no UTF-8 become the replacement character, as in the library. Null ids are none. Rows are
    numbered, so repeated and null doc_ids stay apart.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, b.hex()) for i, b in enumerate(piece_list(vocabulary))], "id int, piece string")
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "ids")
    every = numbered.select("row", "doc_id", F.posexplode_outer("ids").alias("position", "id"))
    found = every.join(F.broadcast(table), "id", "left")
    placed = F.array_sort(F.collect_list(F.struct("position", "piece")))
    joined = found.groupBy("row", "doc_id").agg(F.array_join(placed["piece"], "").alias("hex"))
    return joined.select("doc_id", F.make_valid_utf8(F.unhex("hex").cast("string")).alias("text"))


#: What a document becomes: its ids and their text, or digests of both (ids little-endian, of 32 bits).
ROW = "doc_id long, n_tokens long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _bytes(binary: pa.Array) -> bytes:
    """All values of a binary array in a row."""
    offsets = memoryview(binary.buffers()[1]).cast("i")[binary.offset : binary.offset + len(binary) + 1]
    return bytes(memoryview(binary.buffers()[2])[offsets[0] : offsets[-1]]) if len(binary) and offsets[0] < offsets[-1] else b""


def _joined(digests: bool, piece_bytes: list[bytes], kind: str):
    """Takes the ids of each document's words by their numbers, and the pieces of these ids, for one block."""

    def joined(docs: pa.Table, found: pa.Table) -> pa.Table:
        import numpy as np

        numbers = {p: c.values.to_numpy() for p, c in zip(docs["part"].to_pylist(), docs["codes"]) if p is not None}
        docs = docs.filter(pa.compute.is_null(docs["part"]))
        code = np.concatenate([np.empty(0, np.int32), *(numbers[p] for p in found["slice"].to_pylist())])
        size = np.concatenate([np.empty(0, np.int32), *(x.values.to_numpy() for x in found["size"])])
        ids = np.frombuffer(b"".join(found["ids"].to_pylist()), kind).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size)])
        order = pa.array(np.argsort(code))  # a block's numbers are gapless
        word_ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
        pieces_of = pa.array(piece_bytes, pa.binary()).take(pa.array(ids, pa.int32()))  # the join by id
        starts = np.frombuffer(pieces_of.buffers()[1], np.int32)[: len(pieces_of) + 1] if len(ids) else np.zeros(1, np.int32)
        word_bytes = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(starts[ends].astype(np.int32)), pieces_of.buffers()[2]])
        word_ids, word_bytes = word_ids.take(order), word_bytes.take(order)
        rows: list[list] = [[], [], []]
        for codes in docs["codes"]:
            own = word_ids.take(codes.values).flatten().to_numpy().astype("<u4")
            text = _bytes(word_bytes.take(codes.values)).decode("utf-8", "replace")
            rows[0].append(len(own))
            rows[1].append(sha256(own.tobytes()).hexdigest() if digests else own.astype("i4"))
            rows[2].append(sha256(text.encode()).hexdigest() if digests else text)
        columns = [docs["doc_id"].combine_chunks(), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string() if digests else pa.list_(pa.int32())), pa.array(rows[2], pa.string())]
        return pa.table(columns, ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])

    return joined


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, digests: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Encode every text of ``docs`` and decode its ids: doc_id, n_tokens, ids, decoded, or the SHA-256 of both last.

    Ids are those that the library gives with ``add_special_tokens=False``: an added token that stands in a
    text is that token. The decoded text is the library's with ``skip_special_tokens=False``. A null or empty
    text has no ids and decodes to the empty text; repeated rows and null ids give rows of their own.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    table = _bucketed(texts.mapInArrow(_split(vocabulary, partitions * PARTS, block_words), SPLIT), partitions)
    known = piece_list(vocabulary)
    kind = _id_type(len(known))
    words = table.where("part is not null").select("part", "block", "words", "sizes")
    encoded = words.groupBy("part").applyInArrow(_encode(vocabulary, kind), ENCODED)
    blocks = table.select("block", "part", "doc_id", "codes").groupBy("block")
    return blocks.cogroup(encoded.groupBy("home")).applyInArrow(_joined(digests, known, kind), DIGESTS if digests else ROW)
