"""Token ids of a corpus in fixed-width bit-packed files.

A file set is a Parquet data set whose rows are blocks; Spark's committers write it, so a lost
executor leaves no half block behind.  A block holds whole documents in ascending id order::

    part, block   place in the global order (part: range of doc_id, block: number within it)
    width         bits of an id: the fewest that hold the vocabulary
    least_id, greatest_id   of its documents: readers skip blocks (and row groups) by them
    doc_ids       int64 little-endian, one for each document
    offsets       uint32/uint64 little-endian, documents + 1: first id of each document within the block
    n_ids         ids in the block
    payload       n_ids * width bits, id i at bit i * width, most significant bit first

Any id is found by its bit address alone, and numpy unpacks a whole block or any run of ids at once.
"""

from __future__ import annotations

import json
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, ship, table

#: Ids after which a block ends (with the document that is open).
BLOCK_IDS = 1 << 19
#: Word pieces kept by a worker between batches.
CACHE = 900_000
#: Characters of texts that are encoded together: pieces are looked up once in each lot.  More take less time and more memory.
LOT_CHARS = 4 << 20
#: Letters below are letters to every version of Unicode.
LATIN_END = chr(0x250)
SCHEMA = "block long, width int, least_id long, greatest_id long, doc_ids binary, offsets binary, n_ids long, payload binary"


def id_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def _lanes(width: int) -> list[list[tuple[int, int]]]:
    """For each byte of a group of 8 ids (``width`` bytes) the ids that have bits in it: (id, how far its bits go left)."""
    return [[(i, i * width + width - 8 * byte - 8) for i in range(8 * byte // width, min(7, (8 * byte + 7) // width) + 1)] for byte in range(width)]


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width, each in ``width`` bits, most significant first; the last byte is filled with 0."""
    n = len(ids)
    groups = np.zeros((-(-n // 8), 8), np.uint64)
    groups.ravel()[:n] = ids
    out = np.zeros((len(groups), width), np.uint8)
    for byte, parts in enumerate(_lanes(width)):
        # the id's last bit is ``right`` bits before the byte's last one: bits beyond the byte fall off
        for i, right in parts:
            v = groups[:, i]
            out[:, byte] |= ((v >> np.uint64(right)) if right >= 0 else (v << np.uint64(-right))).astype(np.uint8)
    return out.tobytes()[: (n * width + 7) // 8]


def unpack(payload: bytes, width: int, start: int = 0, n: int | None = None) -> np.ndarray:
    """Ids start .. start + n of a payload, as uint32, without touching what is before or after (but for a group of 8)."""
    if n is None:
        n = len(payload) * 8 // width - start
    first, last = start // 8, -(-(start + n) // 8)
    raw = np.frombuffer(payload, np.uint8, min(len(payload), last * width) - first * width, first * width)
    if len(raw) < (last - first) * width:
        raw = np.concatenate([raw, np.zeros((last - first) * width - len(raw), np.uint8)])
    groups = raw.reshape(-1, width)
    out = np.zeros((len(groups), 8), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for byte, parts in enumerate(_lanes(width)):
        v = groups[:, byte].astype(np.uint32)
        for i, right in parts:
            out[:, i] |= ((v << np.uint32(right)) if right >= 0 else (v >> np.uint32(-right))) & mask
    return out.ravel()[start - 8 * first :][:n]


def _strings(column: pa.Array) -> list[str]:
    """to_pylist(), several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """encode(text, add_special_tokens=False) of a byte-level BPE without prefix space, with a cache.

    Strings of special tokens in a text are those tokens, as the library has it; with ``plain_specials``
    they are ordinary text.  Texts that hold one go to the library whole.

    Such a tokenizer never joins across a single space that a non-space follows, so a text falls
    into pieces that begin at those spaces, and a piece's ids depend on the piece alone.  Pieces
    that begin with other white space stay with what is before them.  Within a piece letters and
    the ASCII punctuation after them are told apart too, so a word is encoded once for all of these.
    With the library's own byte-level pattern a single line feed is a unit as well: lines fall apart.
    Texts that are encoded together look each different piece up once.
    """

    #: White space that may follow a space without being one.
    SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32)
    END_MARKS = string.punctuation

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer

        self.path, self.library = path, None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces hold no special tokens: it needn't look for them
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = tuple(t.content for t in added if not (t.special and plain_specials))
        # bytes as the visible characters that byte-level models are made of
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.visible = np.arange(256).astype("<u2")
        self.visible[hidden] = 256 + np.arange(len(hidden))
        self.most = CACHE
        splitter = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        self.lines = self.tokenizer.normalizer is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        self.byte_level = True
        probe = ["a", "the", "Étre", "über", "anderwhithonre"]
        self.byte_level = self._word_ids(probe) == self._ids([" " + p for p in probe])
        # ids of pieces, by what stands before them
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def plain(self, text: str) -> str | None:
        """A text with one space before each of its pieces but the first, if every space is single and a non-space follows it.

        Where lines fall apart a piece may begin with the line feed before it, and has no space of its own then.
        """
        spaces = self.SPACES[:9] if text.isascii() else self.SPACES
        if self.lines and "\n" in text and "\n\n" not in text and not any(c in text for c in spaces if c != "\n"):
            text = text.replace("\n", " \n")
        elif any(" " + c in text for c in spaces):
            return None
        return None if text[0] == " " or text[-1] == " " or "  " in text else text

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if not p or p[0].isspace() or not out[-1].strip():
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """In lots: an Encoding takes a kilobyte."""
        lots = (pieces[at : at + 20_000] for at in range(0, len(pieces), 20_000))
        return [array("I", e.ids).tobytes() for lot in lots for e in self.tokenizer.encode_batch_fast(lot, add_special_tokens=False)]

    def _word_ids(self, words: list[str], before: str = " ") -> list[bytes]:
        """Words of Latin letters, after a space or not: a run of letters is one unit of the model, handed to it directly."""
        if not words:
            return []
        split = self.tokenizer.model.tokenize
        raw = np.frombuffer("\n".join([before + w for w in words]).encode(), np.uint8)
        seen = self.visible[raw].tobytes().decode("utf-16-le").split(chr(self.visible[10]))
        return [array("I", [t.id for t in split(w)]).tobytes() for w in seen]

    def _learn(self, new: list[str], before: str) -> None:
        """Keep the ids of pieces that aren't kept yet."""
        words, others = [], []
        for p in new:
            (words if self.byte_level and p.isalpha() and (p.isascii() or max(p) < LATIN_END) else others).append(p)
        self.known[before].update(zip(words, self._word_ids(words, before), strict=True))
        self.known[before].update(zip(others, self._ids([before + p for p in others]), strict=True))

    def piece_ids(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of pieces with a space ``before`` them or nothing: kept, new, or put together from others' (and not kept then)."""
        known = self.known[before]
        found = list(map(known.get, pieces))
        lacking = [n for n, ids in enumerate(found) if ids is None]
        begun, ended, own = [], [], []
        for n in lacking:
            p = pieces[n]
            if p.isalpha():
                own.append(n)
            elif before and self.lines and p[:1] == "\n":  # there is no space after a line feed
                begun.append(n)
            elif len(core := p.rstrip(self.END_MARKS)) < len(p) and core.isalpha():
                ended.append((n, core, p[len(core) :]))
            else:
                own.append(n)
        if own:
            self._learn(list(dict.fromkeys([pieces[n] for n in own])), before)
            for n in own:
                found[n] = known[pieces[n]]
        if begun:
            [feed] = self.piece_ids(["\n"], "")
            for n, ids in zip(begun, self.piece_ids([pieces[n][1:] for n in begun], ""), strict=True):
                found[n] = feed + ids
        if ended:
            numbers, cores, tails = zip(*ended, strict=True)
            for n, core, tail in zip(numbers, self.piece_ids(cores, before), self.piece_ids(tails, ""), strict=True):
                found[n] = core + tail
        return found

    def _forget(self, asked: dict[str, list[str]]) -> None:
        """If more is kept than should be, drop what has been kept longest, but none of the pieces that were just asked for."""
        total = sum(map(len, self.known.values()))
        if total <= self.most:
            return
        for before, known in self.known.items():
            stay = len(known) * (self.most // 2) // total
            self.known[before] = dict(islice(known.items(), len(known) - stay, None))
            if sum(map(len, asked.values())) <= self.most // 2:
                self.known[before].update((p, known[p]) for p in asked[before] if p in known)

    def _spaced_ids(self, names: pa.Array, asked: dict[str, list[str]]) -> list[bytes]:
        """Ids of many different pieces after a space; the marks that end words are told apart in bulk."""
        trimmed = pc.utf8_rtrim(names, self.END_MARKS)
        encoded = trimmed.dictionary_encode()
        at, cores = encoded.indices.to_numpy().copy(), _strings(encoded.dictionary)
        letters = pc.utf8_length(trimmed).to_numpy()
        shorter, word = letters < pc.utf8_length(names).to_numpy(), np.fromiter(map(str.isalpha, cores), bool, len(cores))[at]
        ended, others = np.flatnonzero(shorter & word), np.flatnonzero(shorter & ~word)
        at[others] = len(cores) + np.arange(len(others))
        cores += _strings(names.take(pa.array(others)))
        asked[" "] += cores
        out = list(map(self.piece_ids(cores, " ").__getitem__, at.tolist()))
        tails = [p[n:] for p, n in zip(_strings(names.take(pa.array(ended))), letters[ended].tolist(), strict=True)]
        for n, ids in zip(ended.tolist(), self.piece_ids(tails, ""), strict=True):
            out[n] += ids
        return out

    def _encode_plain(self, texts: list[str], asked: dict[str, list[str]]) -> list[np.ndarray]:
        """Texts of ``plain``: each different piece among them is looked up once, and added to those ``asked`` for."""
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        pieces = parts.values.dictionary_encode()
        names, at = pieces.dictionary, pieces.indices.to_numpy().copy()
        bounds = parts.offsets.to_numpy()
        # a text's first piece has no space before it: such pieces get numbers of their own
        firsts, number = np.unique(at[bounds[:-1]], return_inverse=True)
        at[bounds[:-1]] = len(names) + number
        used = np.flatnonzero(np.bincount(at, minlength=len(names))[: len(names)])
        bare = _strings(names.take(pa.array(firsts)))
        asked[""] += bare
        found = self._spaced_ids(names.take(pa.array(used)), asked) + self.piece_ids(bare, "")
        table = np.frombuffer(b"".join(found), "<u4")
        lengths = np.zeros(len(names) + len(firsts), np.int64)
        lengths[np.concatenate([used, np.arange(len(names), len(lengths))])] = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = lengths.cumsum() - lengths
        run = lengths[at]
        ends = run.cumsum()
        flat = table[np.repeat(starts[at] - ends + run, run) + np.arange(ends[-1])]
        return np.split(flat, ends[bounds[1:-1] - 1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.array([], "<u4")] * len(texts)
        even, rough = {}, {}
        for n, text in enumerate(texts):
            if not text:
                continue
            if any(a in text for a in self.added):
                if self.library is None:
                    self.library = type(self.tokenizer).from_file(self.path)
                out[n] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            elif (spread := self.plain(text)) is not None:
                even[n] = spread
            else:
                rough[n] = self.pieces(text)
        asked = {"": list(set().union(*rough.values())), " ": []}
        if rough:
            ids = dict(zip(asked[""], self.piece_ids(asked[""], ""), strict=True))
            for n, own in rough.items():
                out[n] = np.frombuffer(b"".join([ids[p] for p in own]), "<u4")
        if even:
            for n, own in zip(even, self._encode_plain(list(even.values()), asked), strict=True):
                out[n] = own
        self._forget(asked)
        return out


def lots(texts: list[str | None], chars: int = LOT_CHARS) -> Iterator[tuple[int, int]]:
    """Where runs of texts begin and end; a run ends with the text that fills it."""
    at = size = 0
    for n, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= chars or n == len(texts):
            yield at, n
            at, size = n, 0


def _encoder(path: str, plain_specials: bool) -> Encoder:
    """The worker process' own encoder, kept from task to task."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_bitloom_encoders", {})
    if (path, plain_specials) not in held:
        held[path, plain_specials] = Encoder(path, plain_specials)
    return held[path, plain_specials]


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS, plain_specials: bool = False, cache: int = CACHE, lot_chars: int = LOT_CHARS) -> None:
    """Encode every text and write the file set to ``path``, documents in ascending id order.

    A null or empty text has no ids of its own; ``end_id`` closes every document.  Null ids come
    first, repeated ids stand next to one another, by the hash of their texts.  The texts are dealt by
    ranges of (id, hash) (a sampled range sort), so no task sees more than its range.  An empty table
    gives an empty file set; extra columns aren't read.  A worker keeps the ids of up to ``cache`` pieces
    and encodes texts of ``lot_chars`` characters together.
    """
    width = id_width(vocabulary)
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer_path, plain_specials)
        encoder.most = cache
        ids: list[np.ndarray] = []
        held: list[int] = []
        total, number = 0, 0

        def block() -> pd.DataFrame:
            counts = np.array([0, *map(len, ids)], np.uint64).cumsum()
            flat = np.concatenate(ids) if ids else np.array([], np.uint32)
            return pd.DataFrame({"block": [number], "width": [width], "least_id": [held[0]], "greatest_id": [held[-1]], "doc_ids": [np.array(held, "<i8").tobytes()], "offsets": [counts.astype("<u8").tobytes()], "n_ids": [len(flat)], "payload": [pack(flat, width)]})

        for pdf in batches:
            texts = pdf["text"].tolist()
            docs_of = pdf["doc_id"].tolist()
            for at, end in lots(texts, lot_chars):
                for doc, own in zip(docs_of[at:end], encoder.encode(texts[at:end]), strict=True):
                    own = np.concatenate([own, tail])
                    ids.append(own)
                    held.append(NULL_ID if doc is None or doc != doc else int(doc))
                    total += len(own)
                    if total >= block_ids:
                        yield block()
                        ids, held, total, number = [], [], 0, number + 1
        if held:
            yield block()

    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("order"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "doc_id", "order").sortWithinPartitions("doc_id", "order")
    out = dealt.select("doc_id", "text").mapInPandas(blocks, SCHEMA).withColumn("part", F.spark_partition_id())
    out.write.option("compression", "zstd").parquet(path)


#: Stands for a null id within a block.
NULL_ID = -(1 << 63)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` counts the ids of all documents before it: block totals are prefix-summed within
    each part and over parts (two small windows), the rest is in the block itself.
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    in_part = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    by_part = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    starts = in_part.join(by_part, "part").select("part", "block", (F.col("base") + F.col("inner")).alias("first"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                offsets = np.frombuffer(b.offsets, "<u8").astype(np.int64)
                raw = unpack(b.payload, b.width, 0, b.n_ids).astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": np.frombuffer(b.doc_ids, "<i8"), "part": b.part, "block": b.block, "at": offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": np.array(crc, np.int64)})

    found = blocks.mapInPandas(documents, "doc_id long, part int, block long, at long, n_tokens long, ids_crc32 long")
    out = found.join(starts, ["part", "block"])
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Random access: doc_id and ids (array) of a few documents; only their runs of bits are unpacked."""
    wanted = np.array(doc_ids, np.int64)
    near = F.lit(False)
    for i in doc_ids:
        near = near | ((F.col("least_id") <= i) & (F.col("greatest_id") >= i))

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                held, offsets = np.frombuffer(b.doc_ids, "<i8"), np.frombuffer(b.offsets, "<u8").astype(np.int64)
                for i in np.flatnonzero(np.isin(held, wanted)):
                    yield pd.DataFrame({"doc_id": [held[i]], "ids": [unpack(b.payload, b.width, offsets[i], offsets[i + 1] - offsets[i]).astype(np.int64)]})

    return spark.read.parquet(path).where(near).mapInPandas(some, "doc_id long, ids array<long>")


def encode_documents(docs: DataFrame, tokenizer_path: str, vocabulary: int, name: str = "tokens", **options) -> DataFrame:
    """Write the file set into the shared folder and return what its documents read back as."""
    spark = docs.sparkSession
    path = new_path(spark, name)
    write_blocks(docs, path, tokenizer_path, vocabulary, **options)
    return read_documents(spark, path)


def default_tokenizer() -> tuple[str, int]:
    """(path, number of ids) of the tokenizer that the query names; the number is the file's own."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path).get_vocab_size()


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *default_tokenizer())


ship(__name__)
