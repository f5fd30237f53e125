"""Token ids in ORC files: written in ascending document order, read back.

Documents are dealt by ranges of doc_id, and of a hash of the text where an id
repeats, and sorted within; each task tokenizes its range and writes stripes whose integer columns are run-length
encoded, with row indexes, and a Bloom filter on doc_id.  A reader of a few
ids skips files, stripes and row groups by that metadata; a reader of all
takes the stripes in parallel.
"""

from __future__ import annotations

import os
import string
import zlib
from collections import ChainMap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenspan.llm.common import bound_batches, lean, materialize, scratch_path

END_ID, MAX_CACHE, CHUNK = 2, 800_000, 4 << 20
#: How a byte-level vocabulary writes a space and a line's end.
SPACE, LINE_END = "\u0120", "\u010a"
#: Stands for the ids of a part whose text must be encoded whole; no other part has none.
ALONE = b""
#: Marks that the splitting rule parts from the letters before them.
STOPS = string.punctuation

ORC_OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(32 << 20),
    "compression": "lz4",
}
_workers: dict = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The tokenizer with a memory of words.

    A byte-level BPE never joins what stands before a space that leads a word
    with that word, so a text's ids are those of its parts, each but the first
    a space and what follows up to the next.  Nor does it join a line's end that
    stands alone with what is beside it, or letters with marks after them: such
    parts are put together from a word, marks, a word that a line's end leads,
    and marks.  Unknown words are encoded many at a time; a token that begins
    with what leads a word begins a word.  A text in which white space follows a
    space, or which may hold a special token, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids of words by what leads them, and of marks; parts that were put
        #: together stand among the words that a space leads.
        self.known: dict[str, dict[str, bytes]] = {" ": {}, "\n": {}, "": {}}
        vocab = self.tokenizer.get_vocab()
        self.leads = {x: np.zeros(max(vocab.values()) + 1, bool) for x in (" ", "\n")}
        self.leads[" "][[i for token, i in vocab.items() if token.startswith(SPACE)]] = True
        self.leads["\n"][[i for token, i in vocab.items() if token.startswith(LINE_END)]] = True

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, lead: str, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words that ``lead`` leads, and those known before.
        The memory holds the first words met."""
        got: dict[str, bytes] = {}
        for lo in range(0, len(words), 2000):
            part = words[lo : lo + 2000]
            if lead:
                ids = self._encode([lead + lead.join(part)])[0]
                cuts = np.flatnonzero(self.leads[lead][ids]) * 4
                if len(cuts) == len(part):
                    flat, cuts = ids.tobytes(), cuts.tolist()
                    got.update(zip(part, map(flat.__getitem__, map(slice, cuts, [*cuts[1:], len(flat)])), strict=True))
                    continue
            got.update(zip(part, [x.tobytes() for x in self._encode([lead + x for x in part])], strict=True))
        known = self.known[lead]
        if len(known) < MAX_CACHE:
            known.update(got)
            return known
        return ChainMap(got, known) if got else known

    def _look_up(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words that a space leads; ALONE where that cannot
        be told without the text."""
        spaced, lined, marks = self.known[" "], self.known["\n"], self.known[""]
        out = list(map(spaced.get, words))
        new: dict[str, dict[str, None]] = {" ": {}, "\n": {}, "": {}}
        new_spaced, new_lined, new_marks = new.values()
        parted: list[tuple[int, str, str, str, str]] = []
        for i in [i for i, x in enumerate(out) if x is None]:
            p = words[i]
            if not p or p[0].isspace() or "<|" in p:
                out[i] = ALONE
                continue
            word, second, after = p, "", ""
            if "\n" in p:
                before, _, rest = p.partition("\n")
                if rest and "\n" not in rest and not (before[-1].isspace() or rest[0].isspace() or rest[-1].isspace()):
                    word, second = before, rest
                    if not rest.isalpha() and (stem := rest.rstrip(STOPS)).isalpha():
                        second, after = stem, rest[len(stem) :]
            mark = ""
            if not word.isalpha() and (stem := word.rstrip(STOPS)).isalpha():
                word, mark = stem, word[len(stem) :]
            parted.append((i, word, mark, second, after))
            if word not in spaced:
                new_spaced[word] = None
            if mark and mark not in marks:
                new_marks[mark] = None
            if second:
                if second not in lined:
                    new_lined[second] = None
                if after and after not in marks:
                    new_marks[after] = None
        spaced, lined, marks = (self._learn(lead, list(fresh)) for lead, fresh in new.items())
        for i, word, mark, second, after in parted:
            ids = spaced[word]
            if mark:
                ids += marks[mark]
            if second:
                ids += lined[second]
                if after:
                    ids += marks[after]
            out[i] = ids
        if len(self.known[" "]) < MAX_CACHE:
            self.known[" "].update([(words[x[0]], out[x[0]]) for x in parted if x[2] or x[3]])
        return out

    def encode(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, each followed by
        ``end`` if given; and how many are each text's.  Words are parted and
        numbered by Arrow, and each distinct one is looked up once."""
        parts = pc.split_pattern(texts, " ")
        values, offsets = parts.flatten(), parts.offsets.to_numpy()
        offsets = (offsets - offsets[0]).astype(np.int64)
        numbered = values.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() takes ten times as long
        ids = self._look_up(words)
        first = values.take(pa.array(offsets[:-1])).to_numpy(zero_copy_only=False).tolist()
        ids += [x.tobytes() for x in self._encode(first)]
        ids.append(b"" if end is None else np.array([end], "<u4").tobytes())
        table = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        alone = size == 0
        alone[len(words) :] = False
        begin = (np.cumsum(size) - size).astype(np.int32)
        number = numbered.indices.to_numpy().astype(np.int32)
        number[offsets[:-1]] = len(words) + np.arange(len(texts))  # no space leads a text's first word
        number = np.insert(number, offsets[1:], len(ids) - 1)
        offsets = offsets + np.arange(len(offsets))
        each = size[number]
        out = table[np.repeat(begin[number] - (np.cumsum(each) - each).astype(np.int32), each) + np.arange(each.sum(), dtype=np.int32)]
        length = np.add.reduceat(each, offsets[:-1]).astype(np.int64)
        owner = np.searchsorted(offsets, np.flatnonzero(alone[number]), "right") - 1
        whole = sorted({*owner.tolist(), *[i for i, x in enumerate(first) if "<|" in x]})
        if not whole:
            return out, length
        pieces = np.split(out, np.cumsum(length)[:-1])
        for i in whole:  # texts with a part that cannot stand alone
            got = self._encode([texts[i].as_py()])[0].astype(np.int32)
            pieces[i] = got if end is None else np.append(got, np.int32(end))
            length[i] = len(pieces[i])
        return np.concatenate(pieces), length


def slices(batches, column: str, limit: int = CHUNK):
    """(batch slice, its texts) of about ``limit`` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(at // limit)) + 1, len(at)])
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(lo, hi - lo)
            yield part, part.column(part.schema.get_field_index(column))


def encoder(path: str) -> Encoder:
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def write(docs: DataFrame, out: str, *, tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """ORC files at ``out``: doc_id, ids (the text's ids and end_id), part and
    pos, by which (part, pos) is the order of doc_id, NULLs first, and of the
    text's hash and the text where an id repeats.  The driver sees sampled
    numbers only, never texts."""
    path = tokenizer or vocabulary()
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("_hash", F.xxhash64("text"))
    ordered = src.repartitionByRange(n, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        enc, pos = encoder(path), 0
        for batch, texts in slices(batches, "text"):
            flat, length = enc.encode(texts, end_id)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, batch.column(2), pa.array(np.arange(pos, pos + len(length)))], names=["doc_id", "ids", "part", "pos"])
            pos += len(length)

    ordered.mapInArrow(lean(run), "doc_id bigint, ids array<int>, part int, pos bigint").write.options(**ORC_OPTIONS).orc(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents' ids; a filter on doc_id is pushed into the ORC reader."""
    return spark.read.schema("doc_id bigint, ids array<int>, part int, pos bigint").orc(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before
    it), n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers).

    Only numbers of a few bytes are shuffled.  A range's length is summed
    first; the sums, one row a range, then give each range its start.
    """

    def digest(batches):
        _workers.clear()  # words remembered while writing are not needed here
        for b in batches:
            ids = b.column(1)
            flat, off = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")), ids.offsets.to_numpy()
            view = memoryview(flat).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * e]) for a, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    rows = read(spark, path).mapInArrow(lean(digest), "doc_id bigint, part int, pos bigint, n_tokens bigint, ids_crc32 bigint")
    rows = materialize(rows, "token-index")
    lengths = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = lengths.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_before"))
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return rows.withColumn("_in", within).join(F.broadcast(before), "part").select("doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, **options) -> DataFrame:
    """write() to the shared folder, then index().

    NULL and empty texts hold the end id alone; NULL ids come first; rows that
    repeat a doc_id are ordered by the text's hash, then text, and equal rows take
    places of their own; an empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    out = scratch_path(spark, "token-ids")
    write(docs, out, **options)
    return index(spark, out)
