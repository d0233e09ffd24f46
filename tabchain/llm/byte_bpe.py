"""Byte-level BPE by a global shuffle of distinct words, and its decoding.

Documents are gathered into blocks of a bounded size. A block lists its distinct
pre-tokens once and, for every position, the number of the one that stands there.
The distinct ones leave their block, dealt to buckets by a hash of their bytes, so
that equal words of all blocks meet in one place; there each distinct word is
encoded once, its ids are joined back to the blocks that have it, and a block's
documents are put together again by position. What travels is packed: a row is one
block's share of a bucket. A frequent word is one entry per block, not one per
occurrence; a bucket is cut so that its words are bounded in number, and no step
holds more than a block or a bucket.

Decoding lists the distinct ids of a block in the same way, a row for each, and
joins the table of token bytes by id.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabchain.session import scratch_path

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
#: Distinct words of a block, and positions of it: it ends with the document that
#: reaches either. Its positions are kept in parts, which are handled one by one.
BLOCK_WORDS = 400_000
BLOCK_POSITIONS = 8_000_000
PART_POSITIONS = 1_000_000
#: Positions of a block of ids, which only has to outnumber the vocabulary.
ID_BLOCK_POSITIONS = 500_000
#: Bits of a block's number within its task, and of a part's within its block.
NUMBER_BITS = 16
#: Documents of a batch that are Python objects at a time.
ROWS_AT_ONCE = 512
#: Words of a block that are numbered by frequency.
FREQUENT_WORDS = 4_096
#: Distinct words of all blocks together that a bucket has on average.
BUCKET_WORDS = 400_000
#: Bytes of a word up to which the library encodes it; it overflows its stack on very long ones.
LIBRARY_BYTES = 1_000

_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("part", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("places", pa.binary()),
        ("n_words", pa.int64()),
        ("words", pa.binary()),
    ]
)
_BLOCK_SQL = "block long, part long, ids array<long>, ends array<long>, places binary, n_words long, words binary"
_SHARE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("numbers", pa.binary()), ("words", pa.binary())])
_SHARE_SQL = "block long, bucket long, numbers binary, words binary"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
_ENCODED_SQL = "doc_id long, n_tokens long, ids binary"
_TOKENS = pa.schema(
    [
        ("block", pa.int64()),
        ("number", pa.int64()),
        ("id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("ends", pa.list_(pa.int64())),
        ("places", pa.binary()),
    ]
)
_TOKENS_SQL = "block long, number long, id long, doc_ids array<long>, ends array<long>, places binary"
_DECODED = pa.schema([*_ENCODED, ("decoded", pa.binary())])
_DECODED_SQL = f"{_ENCODED_SQL}, decoded binary"


def ranks_path(name: str = RANKS_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def token_ranks(path: str) -> dict[bytes, int]:
    """Rank (which is the id) of every token, from a file of base64 tokens and ranks."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _library(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=token_ranks(path), special_tokens={})


def encode_word(word: bytes, path: str, pattern: str) -> list[int]:
    """Ids of one pre-token, which is a single match of the pattern in itself too."""
    if len(word) <= LIBRARY_BYTES:
        return _library(path, pattern).encode_ordinary(word.decode())
    return merged(word, token_ranks(path))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length, in ``n log n`` steps.

    The neighbours whose union has the lowest rank are merged, the leftmost first,
    until no two neighbours are a token together. Neighbours are linked by number.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    parts = [word[k : k + 1] for k in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[a + b], k, a + b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
    heapq.heapify(heap)

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else n
        if right < n and (pair := parts[left] + parts[right]) in ranks:
            heapq.heappush(heap, (ranks[pair], left, pair))

    while heap:
        _, left, pair = heapq.heappop(heap)
        right = after[left]
        if not parts[left] or right >= n or parts[left] + parts[right] != pair:
            continue  # one of the two was merged meanwhile
        parts[left], parts[right] = pair, b""
        after[left] = after[right]
        if after[right] < n:
            before[after[right]] = left
        offer(before[left])
        offer(left)
    return [ranks[part] for part in parts if part]


#: Character classes of the splitting pattern, each with a character that is in it for
#: every version of Unicode and in none of the pattern's fixed words. Fixed values.
STAND_INS = ((r"\p{L}", "b"), (r"\p{N}", "0"), (None, ""))


@lru_cache(maxsize=1)
def reclassified() -> dict[int, str]:
    """Characters that the two regular-expression libraries put into different classes.

    They follow different versions of Unicode. Each such character is given with the
    stand-in of the class that the encoder's library has it in.
    """
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF)
    single = {bytes([k]): k for k in range(256)}
    there: dict[str, str] = {}
    here: dict[str, str] = {}
    for name, stand_in in STAND_INS[:-1]:
        one = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        there |= dict.fromkeys(one.decode_bytes(one.encode_ordinary(every)).decode(), stand_in)
        here |= dict.fromkeys(regex.findall(name, every), stand_in)
    other = STAND_INS[-1][1]
    return {ord(c): there.get(c, other) for c in there.keys() | here.keys() if there.get(c) != here.get(c)}


def ascii_pattern(pattern: str) -> str:
    """The pattern with the letters and numbers of ASCII for those of Unicode."""

    def replaced(found: re.Match) -> str:
        plain = found[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        return plain if plain.startswith("[") else f"[{plain}]"

    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\p\{[LN]\}", replaced, pattern)


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    plain = ascii_pattern(pattern)
    moved = reclassified()
    unicode = regex.compile(pattern)
    return unicode, unicode if r"\p" in plain else re.compile(plain, re.ASCII), frozenset(map(chr, moved)), moved


def words_of(text: str | None, pattern: str) -> list[str]:
    """Every match of the pattern, as the encoder's library would find it."""
    words, plain_words, apart, moved = _splitter(pattern)
    if not text:
        return []
    if text.isascii():
        return plain_words.findall(text)
    if apart.isdisjoint(text):
        return words.findall(text)
    return [text[m.start() : m.end()] for m in words.finditer(text.translate(moved))]


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, thing):
        self[thing] = number = len(self)
        return number


def pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack_list(values: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, values), "<u4", len(values)).tobytes()
    return pack(np.uint32(len(values)).tobytes() + lengths + b"".join(values))


def unpack_list(data: bytes) -> list[bytes]:
    data = unpack(data)
    n = int(np.frombuffer(data, "<u4", 1)[0])
    ends = (np.frombuffer(data, "<u4", n, 4).astype(np.int64).cumsum() + 4 * (n + 1)).tolist()
    return [data[start:end] for start, end in zip([4 * (n + 1), *ends], ends)]


def pack_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first: small numbers leave the other planes empty."""
    return pack(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(unpack(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _renumbered(places: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Places and words under other numbers: the most frequent words first, the rest in their own order.

    Both are shorter once packed: small numbers stand at most places, and neighbours
    in the list of words begin alike.
    """
    order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable").tolist()
    order[FREQUENT_WORDS:] = sorted(order[FREQUENT_WORDS:], key=words.__getitem__)
    number = np.empty(len(words), np.uint32)
    number[order] = np.arange(len(words))
    return number[places], [words[k] for k in order]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of two columns, a few at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(first, ROWS_AT_ONCE)
            yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


def _first_number() -> int:
    """Blocks of a task are numbered from here on."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << NUMBER_BITS


class _WordBlock:
    """Documents of a block as they come in, in parts."""

    def __init__(self, number: int, part_positions: int):
        self.number, self.part_positions = number, part_positions
        self.numbers, self.positions = Numbers(), 0
        self.parts: list[tuple[list, list[int], list[np.ndarray]]] = []

    def add(self, doc_id: int | None, words: list[str]) -> None:
        full = self.parts and self.parts[-1][1][-1] >= self.part_positions
        if not self.parts or full and len(self.parts) < 1 << NUMBER_BITS:
            self.parts.append(([], [], []))
        ids, ends, places = self.parts[-1]
        ids.append(doc_id)
        ends.append((ends[-1] if ends else 0) + len(words))
        places.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.positions += len(words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row per part; the first one has the words."""
        cuts = np.cumsum([ends[-1] for _, ends, _ in self.parts])[:-1]
        every = np.concatenate([x for _, _, places in self.parts for x in places])
        places, words = _renumbered(every, [word.encode() for word in self.numbers])
        for k, ((ids, ends, _), own) in enumerate(zip(self.parts, np.split(places, cuts), strict=True)):
            listed = None if k else pack_list(words)
            yield _batch([(self.number, k, ids, ends, pack_numbers(own), len(words), listed)], _BLOCK)


def _gather_words(pattern: str, positions: int, part_positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _WordBlock(_first_number(), part_positions)
        for doc_id, text in _rows(batches):
            block.add(doc_id, words_of(text, pattern))
            if block.positions >= positions or len(block.numbers) >= BLOCK_WORDS:
                yield from block.rows()
                block = _WordBlock(block.number + 1, part_positions)
        if block.parts:
            yield from block.rows()

    return run


def _deal(buckets: int):
    """A block's words to its shares of the buckets, in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = unpack_list(listed)
                bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                rows = [
                    (block, int(bucket[some[0]]), pack_numbers(np.diff(some, prepend=0)), pack_list([words[k] for k in some.tolist()]))
                    for some in np.split(order, cuts)
                    if len(some)
                ]
                yield _batch(rows, _SHARE)

    return run


def _encode_buckets(encode_one: Callable[[bytes], list[int]]):
    """Shares, bucket after bucket, with the ids of their words for the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                ids = []
                for word in unpack_list(row["words"]):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(encode_one(word), "<u4").tobytes()
                    ids.append(found)
                rows.append((row["block"], bucket, row["numbers"], pack_list(ids)))
            yield _batch(rows, _SHARE)

    return run


def _documents(places: np.ndarray, ids: list, ends: list[int]) -> Iterator[tuple[int | None, list[int]]]:
    start = 0
    for doc_id, end in zip(ids, ends, strict=True):
        yield doc_id, places[start:end].tolist()
        start = end


def _put_together(parts: pa.Table, shares: pa.Table) -> Iterator[tuple[int, list[tuple[int | None, bytes]]]]:
    """Documents of a block, part by part, with the ids at their positions."""
    table: list[bytes] = [b""] * parts["n_words"][0].as_py()
    for k in range(shares.num_rows):
        (share,) = shares.slice(k, 1).to_pylist()
        for number, ids in zip(unpack_numbers(share["numbers"]).cumsum().tolist(), unpack_list(share["words"]), strict=True):
            table[number] = ids
    for k in range(parts.num_rows):
        (part,) = parts.slice(k, 1).to_pylist()
        places = _documents(unpack_numbers(part["places"]), part["ids"], part["ends"])
        yield part["part"], [(doc_id, b"".join(map(table.__getitem__, own))) for doc_id, own in places]


def _encoded_documents(parts: pa.Table, shares: pa.Table) -> pa.Table:
    return pa.Table.from_batches(
        _batch([(doc_id, len(ids) // 4, ids) for doc_id, ids in docs], _ENCODED) for _, docs in _put_together(parts, shares)
    )


def _encoded_id_blocks(parts: pa.Table, shares: pa.Table) -> pa.Table:
    """Each part of a block of words as a block of ids."""
    first = parts["block"][0].as_py() << NUMBER_BITS
    found = []
    for number, docs in _put_together(parts, shares):
        ids = [np.frombuffer(x, "<u4") for _, x in docs]
        ends = np.cumsum([len(x) for x in ids]).tolist()
        found += _id_block(first + number, [doc_id for doc_id, _ in docs], ends, ids)
    return pa.Table.from_batches(found)


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    positions: int = BLOCK_POSITIONS,
    part_positions: int = PART_POSITIONS,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """``(doc_id, n_tokens, ids)``, a row per row; ids are little-endian unsigned 32-bit numbers.

    Every match of ``pattern`` in a whole text is encoded by itself; what no match
    covers is left out (the default pattern covers everything). Null and empty texts
    have no ids. Rows that repeat an id or a text, or have no id, are rows of their
    own. Other columns are ignored, whatever their names. No rows give no rows.
    """
    return _encoded(
        docs, _encoded_documents, _ENCODED_SQL, id_col, text_col, path, pattern, positions, part_positions, bucket_words
    )


def _encoded(
    docs: DataFrame,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    positions: int = BLOCK_POSITIONS,
    part_positions: int = PART_POSITIONS,
    bucket_words: int = BUCKET_WORDS,
) -> DataFrame:
    """What ``work`` makes of each block and its encoded words."""
    import public_tokenizers

    path, pattern = path or ranks_path(), pattern or public_tokenizers.PATTERN
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    blocks = stored_in_buckets(texts.mapInArrow(_gather_words(pattern, positions, part_positions), _BLOCK_SQL), "bpe_blocks", "block")
    listed = blocks.where("words IS NOT NULL")
    entries = listed.agg(F.sum("n_words")).first()[0] or 0
    shares = (
        listed.select("block", "words")
        .mapInArrow(_deal(max(1, -(-entries // bucket_words))), _SHARE_SQL)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "block")
        .mapInArrow(_encode_buckets(partial(encode_word, path=path, pattern=pattern)), _SHARE_SQL)
    )
    columns = ["block", "part", "ids", "ends", "places", "n_words"]
    left = blocks.select(*columns).toDF(*columns)
    return left.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(work, schema)


def stored_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Rows written once to the shared folder in buckets of a column and read back.

    What is joined or grouped by that column later need not shuffle them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    rows.schema  # noqa: B018 - resolves the files, before the catalog forgets the name; the files stay
    spark.sql(f"DROP TABLE {table}")
    return rows


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(id, value)``: the bytes of every token of a vocabulary file."""
    tokens, ids = zip(*token_ranks(path or ranks_path()).items(), strict=True)
    return spark.createDataFrame(pa.table([pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], names=["id", "value"]))


def _id_block(block: int, docs: list, ends: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row with the positions of a block's documents, and a row for each distinct id."""
    distinct, places = np.unique(np.concatenate(parts), return_inverse=True)
    yield _batch([(block, len(distinct), None, docs, ends, places.astype("<u4").tobytes())], _TOKENS)
    n = len(distinct)
    nothing = [pa.nulls(n, f.type) for f in list(_TOKENS)[3:]]
    number = pa.array(np.arange(n, dtype=np.int64))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block, np.int64)), number, pa.array(distinct.astype(np.int64)), *nothing], schema=_TOKENS
    )


def _gather_ids(positions: int):
    """Blocks of documents, as their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _first_number()
        docs, ends, parts = [], [], []
        for doc_id, ids in _rows(batches):
            parts.append(np.frombuffer(ids or b"", "<u4"))
            docs.append(doc_id)
            ends.append((ends[-1] if ends else 0) + len(parts[-1]))
            if ends[-1] >= positions:
                yield from _id_block(block, docs, ends, parts)
                block, docs, ends, parts = block + 1, [], [], []
        if docs:
            yield from _id_block(block, docs, ends, parts)

    return run


class _OpenBlock:
    """Rows of a block as they come in."""

    def __init__(self):
        self.head, self.numbers, self.ids, self.values, self.found = None, [], [], [], 0

    def complete(self) -> bool:
        return self.head is not None and self.found == self.head["number"]

    def documents(self) -> pa.RecordBatch:
        ids: list[bytes] = [b""] * self.found
        values: list[bytes | None] = [None] * self.found
        for number, token, value in zip(self.numbers, self.ids, self.values, strict=True):
            ids[number], values[number] = token.to_bytes(4, "little"), value
        places, rows = np.frombuffer(self.head["places"], "<u4"), []
        lacking = None in values
        for doc_id, own in _documents(places, self.head["doc_ids"], self.head["ends"]):
            parts = [values[k] for k in own]
            decoded = None if lacking and None in parts else b"".join(parts)
            rows.append((doc_id, len(own), b"".join(map(ids.__getitem__, own)), decoded))
        return _batch(rows, _DECODED)


def _decoded_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the blocks that a task reads. Rows may come in any order; a block has said how many it has."""
    blocks: dict[int, _OpenBlock] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("block", "number", "id", "value"))
        heads = batch.column("places").is_valid().to_pylist()
        for k, (head, block, number, token, value) in enumerate(zip(heads, *columns, strict=True)):
            one = blocks.get(block)
            if one is None:
                one = blocks[block] = _OpenBlock()
            if head:
                one.head = batch.slice(k, 1).to_pylist()[0]
            else:
                one.numbers.append(number)
                one.ids.append(token)
                one.values.append(value)
                one.found += 1
            if one.complete():
                yield blocks.pop(block).documents()
    if blocks:
        raise RuntimeError("rows of a block were dealt to several tasks")


def decode(
    encoded: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    positions: int = ID_BLOCK_POSITIONS,
) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: the bytes that each row's ids stand for.

    The distinct ids of a block join the table of token bytes, which has as many rows
    as the vocabulary file; that bounds its broadcast. A broadcast join moves no row
    to another task, so a block's rows are together behind it, and nothing is shuffled.
    A row with an id that the vocabulary lacks has null as ``decoded``; no ids give no
    bytes, null ids count as none, and no rows give no rows.
    """
    rows = encoded.select(F.col(id_col).cast("long"), F.col(ids_col))
    return _decoded(rows.mapInArrow(_gather_ids(positions), _TOKENS_SQL), path)


def encode_and_decode(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``decode(encode(docs))``, with blocks of ids made where the blocks of words are put together."""
    return _decoded(_encoded(docs, _encoded_id_blocks, _TOKENS_SQL, path=path, **options), path)


def _decoded(rows: DataFrame, path: str | None) -> DataFrame:
    found = rows.join(F.broadcast(token_bytes(rows.sparkSession, path)), "id", "left")
    return found.select("block", "number", "id", "value", "doc_ids", "ends", "places").mapInArrow(
        _decoded_documents, _DECODED_SQL
    )
