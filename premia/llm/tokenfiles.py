"""Token ids as flat binary files with 64-bit document offsets.

A folder holds shards in ascending order of the key. A shard is three flat little-endian files: ``.ids``
(unsigned integers of 16 bits where the vocabulary allows it, else of 32), ``.ends`` (unsigned 64-bit
offsets of the documents, counted in ids from the start of the shard, one more than there are documents)
and ``.keys`` (signed 64-bit keys). The table ``shards`` names the files of each shard and its base, the
number of ids in all shards before it: an id's place in the whole is base plus offset.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from premia.llm.common import Lexicon
from premia.session import write_table

# Bytes of text that a shard holds, about.
SHARD_BYTES = 128 << 20
# Longer texts are encoded in pieces of about so many characters.
PIECE = 1 << 18
# Characters that are encoded at a time, about, and ids that are read at a time.
TOGETHER = 4 << 20
# Stands for a null key, as the smallest 64-bit integer.
NO_KEY = -(1 << 63)
SHARDS = "shard long, stem string, width int, n_docs long, n_tokens long"

# Words whose ids a task remembers.
REMEMBERED = 1_000_000

# A cut that no token spans: before a space between two letters.
CUT = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def pieces(text: str) -> list[str]:
    """A long text in pieces whose ids, one after another, are those of the text."""
    found, start = [], 0
    while len(text) - start > PIECE and (cut := CUT.search(text, start + PIECE)):
        found.append(text[start : cut.start()])
        start = cut.start()
    return [*found, text[start:]]


# Between words no library call tells apart, and what stands for the end of a document: no word holds either.
NUL, END = b"\0", b" "
# The first bytes of combining marks that letters of ASCII are composed with.
MARKS = (b"\xcc", b"\xcd")


class Encoder:
    """The tokenizers library over many texts; each word is encoded once while it is remembered.

    A vocabulary that drops white space encodes the words between ASCII white space independently: the
    library sees each new one, and a text's ids are those of its words. If it lower-cases too, texts
    without combining marks are first lower-cased in ASCII, which it would do anyway. Other vocabularies
    get whole texts. ``end`` holds the ids that follow every text.
    """

    def __init__(self, content: str, end: tuple[int, ...] = ()):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = np.array(end, np.uint32)
        self.specials = [t["content"].encode() for t in json.loads(content)["added_tokens"]]
        self.lower_specials = [s.lower() for s in self.specials]
        letters = [chr(65 + k) for k in range(26)]
        a, b, nul, *both = self.ids(["a", "b", "\0", "a b", " a\n\t b ", "a\0b"])
        self.nul = nul[0] if len(nul) == 1 else None
        self.drops_space = all(x.tolist() == [*a, *b] for x in both[:2]) and self.nul is not None
        self.lowers = all(map(np.array_equal, self.ids(letters), self.ids([c.lower() for c in letters])))
        self.known = Lexicon(self._find, REMEMBERED)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        made = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in made]

    def _find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words: many in one call, told apart by a token of their own between them."""
        ids, lengths = [], []
        for start in range(0, len(words), 1000):
            some = words[start : start + 1000]
            together = b" \0 ".join(some)
            apart = END in some or together.count(NUL) >= len(some) or any(s in together for s in self.specials)
            if apart:
                made = [self.end if w == END else self.ids([w.decode()])[0] for w in some]
                ids += made
                lengths += map(len, made)
            else:
                (made,) = self.ids([(together + b" \0").decode()])
                ends = np.flatnonzero(made == self.nul)
                ids.append(made[made != self.nul])
                lengths += (np.diff(ends, prepend=-1) - 1).tolist()
        return np.concatenate(ids), np.array(lengths, np.int64)

    def words(self, text: str) -> list[bytes]:
        data = text.encode()
        if self.lowers and (text.isascii() or not any(m in data for m in MARKS)):
            lower = data.lower()
            # A lower-cased word may not become a special token.
            if not any(s in lower for s in self.lower_specials):
                return lower.split()
        return data.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, each with its end, and how many each has."""
        if not self.drops_space:
            made = []
            for text in texts:
                made.append(np.concatenate([*self.ids(pieces(text)), self.end]))
            return np.concatenate([*made, np.empty(0, np.uint32)]), np.array([len(m) for m in made], np.int64)
        words, counts = [], []
        for text in texts:
            own = self.words(text)
            words += own
            words.append(END)
            counts.append(len(own) + 1)
        ids, lengths = self.known.of(words)
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return ids, np.diff(upto)


def _store(path: str):
    """File system of a folder, and its path there."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and rest.startswith("//"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)


def _mapped(path: str, kind: str) -> np.ndarray:
    """A flat file: memory-mapped where it is on a mounted file system, else read."""
    from pyarrow import fs

    store, place = _store(path)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(place, kind, "r") if os.path.getsize(place) else np.empty(0, kind)
    with store.open_input_file(place) as file:
        return np.frombuffer(file.read(), kind)


def write_tokens(
    documents: DataFrame,
    path: str,
    folder: str,
    end_id: int | None = 1,
    text: str = "text",
    key: str = "doc_id",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode whole texts with the tokenizer file ``path`` into shards in ``folder``; returns table ``shards``.

    Special tokens are not added; ``end_id`` follows every document. Very long texts are encoded in pieces, cut
    before a space between two letters, which no token of the usual pre-tokenizers spans. Documents ascend by key, a null key
    first (stored as the smallest integer); rows that share a key stay, in any order. A null text counts as
    empty. An empty table gives no shards. Other columns are not read. A shard is written by one task under
    a name of its own, and the table names the files of the tasks that counted, so a task that is run again
    or twice does no harm. ``folder`` must be one that all executors reach.
    """
    spark = documents.sparkSession
    with open(path, encoding="utf-8") as file:
        content = file.read()
    file = json.loads(content)
    highest = max([end_id or 0, *file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])])
    kind = "<u2" if highest < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(content)  # a tokenizer file: its size does not grow with the data

    rows = documents.select(
        F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY)).alias("key"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    parts = max(-(-(size["bytes"] or 0) // shard_bytes), min(spark.sparkContext.defaultParallelism, size["rows"]), 1)
    # The row number parts rows that share a key, so that a range can end between them.
    ordered = rows.repartitionByRange(int(parts), "key", "row").sortWithinPartitions("key", "row").select("key", "text")

    def write(batches):
        import uuid

        from pyspark import TaskContext

        encoder = Encoder(sent.value, () if end_id is None else (end_id,))
        shard = TaskContext.get().partitionId()
        store, place = _store(folder)
        stem = f"{shard:08d}-{uuid.uuid4().hex}"
        store.create_dir(place, recursive=True)
        width, total, docs = np.dtype(kind).itemsize, 0, 0

        files = [store.open_output_stream(f"{place}/{stem}.{end}") for end in ("ids", "ends", "keys")]
        ids, ends, keys = files
        ends.write(np.zeros(1, "<u8").tobytes())
        for batch in batches:
            texts, start = batch.column("text").to_pylist(), 0
            while start < len(texts):
                stop, size = start + 1, len(texts[start])
                while stop < len(texts) and size < TOGETHER:
                    size += len(texts[stop])
                    stop += 1
                made, lengths = encoder.encode(texts[start:stop])
                ids.write(made.astype(kind).tobytes())
                upto = total + np.cumsum(lengths)
                ends.write(upto.astype("<u8").tobytes())
                total, start = int(upto[-1]), stop
            keys.write(np.asarray(batch.column("key"), "<i8").tobytes())
            docs += len(texts)
        for file in files:
            file.close()
        if docs:
            cells = ([shard], [stem], [width], [docs], [total])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                ["shard", "stem", "width", "n_docs", "n_tokens"],
            )

    # Written once, as a second evaluation would encode again; the table of the folder comes last and is its commit.
    with_bases(write_table(ordered.mapInArrow(write, SHARDS), "shards")).write.parquet(f"{folder}/shards")
    return spark.read.parquet(f"{folder}/shards")


def with_bases(shards: DataFrame, together: int = 1024) -> DataFrame:
    """``shards`` with ``base``: ids in all shards before. Sums within runs of shards, then over the runs."""
    def before(window, value: str):
        return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    runs = shards.select("*", F.floor(F.col("shard") / together).alias("run"))
    inside = runs.withColumn("inside", before(Window.partitionBy("run").orderBy("shard"), "n_tokens"))
    # One row per run: few enough for one task.
    totals = runs.groupBy("run").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("run", before(Window.orderBy("run"), "total").alias("start"))
    return inside.join(starts, "run").select(*shards.columns, (F.col("start") + F.col("inside")).alias("base"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``key``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` of every document in ``folder``.

    ``ids`` are little-endian unsigned 32-bit integers. Each shard is mapped by the task that reads it.
    """
    shards = spark.read.parquet(f"{folder}/shards")

    def read(batches):
        for batch in batches:
            for stem, width, base in zip(*(batch.column(c).to_pylist() for c in ("stem", "width", "base")), strict=True):
                ids, ends, keys = (_mapped(f"{folder}/{stem}.{e}", k) for e, k in (("ids", f"<u{width}"), ("ends", "<u8"), ("keys", "<i8")))
                at = 0
                while at < len(keys):
                    # As many documents as hold about so many ids, one at least.
                    upto = max(at + 1, int(np.searchsorted(ends, ends[at] + np.uint64(TOGETHER), "right")) - 1)
                    bounds = ends[at : upto + 1].astype(np.int64)
                    data = ids[bounds[0] : bounds[-1]].astype("<u4").tobytes()
                    offsets = ((bounds - bounds[0]) * 4).astype(np.int64)
                    values = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
                    )
                    own = np.asarray(keys[at:upto])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == NO_KEY),
                            pa.array(bounds[:-1] + base, pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            values.cast(pa.binary()),
                        ],
                        ["key", "start", "n_tokens", "ids"],
                    )
                    at = upto

    schema = "key long, start long, n_tokens long, ids binary"
    # A shard is a row of this small table: dealt out, so that each is read by a task of its own.
    return shards.select("stem", "width", "base").repartition(max(1, shards.count())).mapInArrow(read, schema)
