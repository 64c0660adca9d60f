"""Token ids of a corpus as flat binary files that are memory-mapped when read.

A corpus is written as parts. Part p has three flat little-endian files: ``part-p.tokens`` (unsigned ids, 16 bits if the vocabulary
fits, else 32), ``part-p.offsets`` (64 bits: where each document begins in the part, and the part's end) and ``part-p.docs`` (64-bit
document ids; the first ``null_ids`` of them are null). The table ``parts`` has a row a part, with the ids and documents before it;
these bases are prefix sums over the parts' totals. It is written last, so a corpus without it was never finished.

Documents are dealt out by ranges of (doc_id, hash of text, place in the input), so a part is a stretch of the corpus in order, and
one id that a third of all rows have is split like any other. Each task encodes its range and streams it to files under another
name, which it renames at the end: a task that runs twice writes the same bytes, and a task that breaks off leaves no part.

Texts are encoded whole. With a tokenizer that cuts texts at white space (``PLAIN``) a blank never stands within a token nor changes its neighbours, so a text is cut at blanks, and words of
plain Latin letters are looked up, or encoded by the tokenizer's own model alone; all else goes through the whole tokenizer. A
special token's name in a text is that token, as the library has it.

Defined results: a null text is empty, and an empty text has the end id only; documents are in order of doc_id, null first, rows of one
id in order of the text's hash; each row is a document, repeated rows too; an empty table has no parts and gives no rows; a very long text is
encoded like any other, and is a batch of its own; other columns are ignored. The folder must be mounted on all executors, as files are mapped.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import slices
from .common import shared_dir

END_ID = 1
#: A part holds about so many bytes of text; a small corpus is cut finer, into parts of at least LEAST_BYTES, so that all cores have work.
PART_BYTES, LEAST_BYTES = 64 << 20, 1 << 20
#: So many words of plain letters are remembered with their ids, some 200 bytes each; then all are forgotten.
WORDS_KEPT = 1 << 20
#: Ids of a document are widened in blocks of so many, for its checksum.
BLOCK = 1 << 20
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ſ]+")
#: Marks that may follow a word: with those that begin or end a special token, and the apostrophe, they would need the whole tokenizer.
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
#: White space that is read as a blank; the tokenizer takes them for the same.
BLANKS = "[\t\n\r]"

#: Fixed: the normaliser and the cutting into words under which words of Latin letters may be encoded alone. With others, whole texts are.
PLAIN = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes many texts with a tokenizer of the library, given as the JSON text of its file."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
        self.whole = Tokenizer.from_str(spec)
        self.model = self.whole.model
        told = json.loads(spec)
        self.plain = told["model"]["type"] == "BPE" and [told["normalizer"], told["pre_tokenizer"]] == PLAIN
        self.letters = byte_letters()
        self.dtype = id_type(self.whole.get_vocab_size())
        self.kept: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """Ids of a word of Latin letters, none of which normalisation changes but for its case."""
        got = self.model.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))
        return np.array([x.id for x in got], dtype=self.dtype).tobytes()

    def others(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; pieces have no blank. A word and the marks after it are tokens of their own."""
        if len(self.kept) + len(pieces) > WORDS_KEPT:
            self.kept.clear()
        out: list[bytes] = []
        odd: list[int] = []
        kept = self.kept
        for i, piece in enumerate(pieces):
            word = piece.rstrip(MARKS)
            known = kept.get(word)
            if known is None:
                if not LATIN.fullmatch(word):
                    odd.append(i)
                    out.append(b"")
                    continue
                known = kept[word] = self.word(word)
            if len(word) < len(piece):
                marks = piece[len(word) :]
                if marks not in kept:
                    kept[marks] = self.others([marks])[0]
                known += kept[marks]
            out.append(known)
        for i, ids in zip(odd, self.others([pieces[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each text's followed by the end id, and how many each text has."""
        if not self.plain:
            each = [np.append(np.array(e.ids, dtype=self.dtype), self.dtype.type(END_ID)) for e in self.whole.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, dtype=self.dtype), *each]), np.array([len(x) for x in each], dtype=np.int64)
        cut = pc.split_pattern(pc.replace_substring_regex(texts.fill_null(""), BLANKS, " "), pattern=" ")
        coded = cut.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        known = self.pieces(coded.dictionary.to_pylist())
        held = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(known), dtype=self.dtype)
        size = held[code]
        ends = np.cumsum(size)
        from_ = (np.cumsum(held) - held)[code] - (ends - size)
        ids = flat[np.repeat(from_, size) + np.arange(ends[-1] if len(ends) else 0)]
        lasts = np.append(0, ends)[np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]
        return np.insert(ids, lasts, END_ID), np.diff(lasts, prepend=0) + 1


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


def local(folder: str) -> str:
    """The folder as the operating system names it."""
    at = urlparse(folder)
    if at.scheme not in ("", "file"):
        raise ValueError("token files are memory-mapped: their folder must be mounted, not " + at.scheme)
    return unquote(at.path) if at.scheme else folder


def paths(folder: str, part: int) -> tuple[str, str, str]:
    return tuple(os.path.join(folder, f"part-{part:06d}.{kind}") for kind in ("tokens", "offsets", "docs"))


def parts_of(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return int(max(1, min(4 * cores, size // LEAST_BYTES), -(-size // PART_BYTES)))


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """docs(doc_id, text), encoded by the tokenizer in that file, to token files in a new folder; returns the table of its parts."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    at = local(folder)
    keys = ["doc_id", "h", "seq"]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = own.withColumn("h", F.xxhash64("text")).withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(parts_of(own), *keys).sortWithinPartitions(*keys)

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(spec.value), TaskContext.get().partitionId()
        os.makedirs(at, exist_ok=True)
        names = paths(at, part)
        made = [f"{x}.{uuid.uuid4().hex}" for x in names]
        docs_n = nulls = tokens = 0
        with open(made[0], "wb") as ids, open(made[1], "wb") as offsets, open(made[2], "wb") as doc_ids:
            offsets.write(np.array([0], dtype="<u8").tobytes())
            for whole in batches:
                for batch in slices(whole, "text"):
                    found, sizes = code.batch(batch.column("text"))
                    own_ids = batch.column("doc_id")
                    ids.write(found.tobytes())
                    offsets.write((np.cumsum(sizes) + tokens).astype("<u8").tobytes())
                    doc_ids.write(own_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    docs_n, tokens, nulls = docs_n + len(sizes), tokens + len(found), nulls + own_ids.null_count
        for old, new in zip(made, names, strict=True):
            os.replace(old, new)
        if docs_n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "docs": [docs_n], "tokens": [tokens], "null_ids": [nulls], "width": pa.array([code.dtype.itemsize], pa.int32())})

    totals = f"{folder}/totals"
    dealt.select("doc_id", "text").mapInArrow(store, "part int, docs long, tokens long, null_ids long, width int").write.parquet(totals)
    return publish(spark, folder, totals)


def publish(spark: SparkSession, folder: str, totals: str) -> DataFrame:
    """Writes and returns the table of parts: the totals with the ids and documents before each part, a row a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c}")
    read = spark.read.schema("part int, docs long, tokens long, null_ids long, width int").parquet(totals)
    read.select("*", base("docs"), base("tokens")).write.parquet(f"{folder}/parts")
    return spark.read.schema("part int, docs long, tokens long, null_ids long, width int, first_docs long, first_tokens long").parquet(f"{folder}/parts")


def part_rows(folder: str, part: int, docs: int, tokens: int, nulls: int, width: int, first: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The documents of a part from its mapped files."""
    names = paths(folder, part)
    for name, size in zip(names, (tokens * width, (docs + 1) * 8, docs * 8), strict=True):
        if os.path.getsize(name) != size:
            raise OSError(f"{name} has {os.path.getsize(name)} bytes, not {size}")
    ids, offsets, doc_ids = (np.memmap(x, dtype=t, mode="r") for x, t in zip(names, (f"<u{width}", "<u8", "<i8"), strict=True))
    for at in range(0, docs, rows):
        to = min(at + rows, docs)
        bounds = offsets[at : to + 1].astype(np.int64)
        sums = []
        for a, b in pairwise(bounds.tolist()):
            crc = 0
            for k in range(a, b, BLOCK):
                crc = zlib.crc32(ids[k : min(k + BLOCK, b)].astype("<u4").tobytes(), crc)
            sums.append(crc)
        own = pa.array(doc_ids[at:to], mask=np.arange(at, to) < nulls)
        yield pa.RecordBatch.from_arrays([own, pa.array(bounds[:-1] + first), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files alone. A part is read by one task, in blocks."""
    at = local(folder)
    parts = spark.read.schema("part int, docs long, tokens long, null_ids long, width int, first_docs long, first_tokens long").parquet(f"{folder}/parts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from part_rows(at, r["part"], r["docs"], r["tokens"], r["null_ids"], r["width"], r["first_tokens"])

    n = max(1, parts.count())
    return parts.repartitionByRange(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(folder: str, part: int, row: int, width: int = 2) -> np.ndarray:
    """The ids of one document of a part, mapped, for training loops."""
    names = paths(local(folder), part)
    offsets = np.memmap(names[1], dtype="<u8", mode="r")
    return np.memmap(names[0], dtype=f"<u{width}", mode="r")[int(offsets[row]) : int(offsets[row + 1])]


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id, text) written to a new folder beside the intermediate tables, and read back."""
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, folder)
    return read(docs.sparkSession, folder)
