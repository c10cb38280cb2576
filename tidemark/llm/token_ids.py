"""Token ids of whole documents in compressed files, and back.

Documents are dealt out by ranges of doc_id, so a partition's files follow those of the partition before. A task
tokenizes its documents, appends the end id to each and writes files of about ``file_ids`` ids: a header (the ids of
the file by frequency and the shares of their classes), independent blocks of ``block`` ids coded by range_coder, and
a footer (size and CRC-32 of each block, id and length of each document, and where it is). A block is read with the
header, the footer and its own bytes alone. The index of files is a table in the shared folder; a task that is run
again writes files of other names, and only those that the index names are read.

The tokenizer is one that drops white space, folds case and never joins letters or digits with .,;:!?#$%&* in a token. So
texts are cut at ASCII white space and where those meet, across which none of its rules reach; the library encodes
each distinct word once (words of letters by the model behind a split at spaces, if the rules before it are known to do
no more to them), and its ids are put in place of every occurrence. The first text of each piece of 6 MB is
encoded whole as well, and a tokenizer that gives other ids for it raises ValueError.

Null texts have no ids but the end id; null doc_ids come first; rows that share a doc_id are ordered by a hash of the
text, and equal rows each have their own place. Very long texts are whole: a file holds whole documents. An empty
table has no files and no rows. Other columns of docs are not looked at. A file whose bytes changed raises ValueError.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, encoded, load, materialize, pack, shared_dir, unpack
from tidemark.llm.range_coder import classes, decode, encode

_MAGIC = b"TIDEIDS2"
_HEAD, _TAIL = struct.Struct("<8sIIQI"), struct.Struct("<QI8s")
_INDEX = "part int, seq int, path string, n_ids long, n_docs long"
#: Words kept with their ids in a worker; beyond it they are encoded anew.
_KEPT = 3 << 19
#: White space, letters and digits (of ASCII here), marks that never stand in one token with those, all else.
_KIND = np.ones(256, np.uint8)
_KIND[list(SPACES)] = 0
_KIND[[i for i in range(128) if chr(i).isalnum()]] = 2
_KIND[list(b".,;:!?#$%&*")] = 4
_KIND = _KIND.tobytes()
_MEET = 2 ^ 4
#: What a tokenizer may do to a text before its model so that words of letters are theirs alone.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Blocks that advance in step, at most.
_LANES = 8192


def _batches(first: int, last: int) -> Iterator[tuple[int, int]]:
    """Blocks first to last - 1 in equal shares that advance in step, as few blocks cost much each."""
    n = max(1, -(-(last - first) // _LANES))
    cuts = [first + (last - first) * i // n for i in range(n + 1)]
    return zip(cuts[:-1], cuts[1:])



def _letters(data: np.ndarray) -> np.ndarray:
    """Where the lead bytes of letters of U+00C0 to U+00FF are, which are all there but two signs."""
    lead = np.flatnonzero(data[:-1] == 0xC3)
    low = data[lead + 1]
    return lead[(low >> 6 == 2) & (low != 0x97) & (low != 0xB7)]


def _of_letters(words: pa.Array) -> pa.Array:
    """Which words (none is empty) have letters of ASCII and of U+00C0 to U+00FF only; their small letters hang on no others around them."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    good = (data | 32) - np.uint8(97) < 26
    lead = _letters(data)
    good[lead] = good[lead + 1] = True
    return pa.array(np.logical_and.reduceat(good, offsets[:-1] - offsets[0]))


class WordIds:
    """Ids of texts by a tokenizer of the tokenizers library that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized}
        #: A special token cuts a text before any other rule, so words that are joined by one are encoded as if alone.
        self.cut, self.cut_id = min(added.items(), key=lambda x: x[1], default=(None, None))
        self.marks = {t.content[0] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.plain, self.last = self._behind_spaces()
        self._clear()

    def _behind_spaces(self) -> tuple:
        """The same model behind a split at spaces only, and which ids end a word; None where other rules might tell words of letters apart."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix or any(spec[k] != v for k, v in _RULES.items()) or any(t["content"][0].isalpha() for t in spec["added_tokens"]):
            return None, None
        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        return plain, last

    def _ids_of_letters(self, words: list[bytes], group: int = 512) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, and how many each has; None if the ends of words cannot be told."""
        texts = [b" ".join(words[i : i + group]).decode().lower() for i in range(0, len(words), group)]
        ids = [np.array(e.ids, np.int64) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        ends = np.flatnonzero(self.last[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids) - 1) else None

    def _clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.starts, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _ids_of(self, words: list[str], group: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        odd = [k for k, w in enumerate(words) if self.cut is None or not self.marks.isdisjoint(w)]
        out: list = [None] * len(words)
        for k, e in zip(odd, self.tokenizer.encode_batch_fast([words[k] for k in odd], add_special_tokens=False)):
            out[k] = e.ids
        plain = [k for k, x in enumerate(out) if x is None]
        texts = [self.cut.join(words[k] for k in plain[i : i + group]) for i in range(0, len(plain), group)]
        sizes = np.zeros(len(words), np.int64)
        sizes[odd] = [len(out[k]) for k in odd]
        joined = [np.array([*e.ids, self.cut_id]) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        joined = np.concatenate(joined) if joined else np.zeros(0, np.int64)
        ends = np.flatnonzero(joined == self.cut_id)
        sizes[plain] = np.diff(ends, prepend=-1) - 1
        ids = np.empty(int(sizes.sum()), np.int64)
        is_odd = np.zeros(len(words), bool)
        is_odd[odd] = True
        of_odd = np.repeat(is_odd, sizes)
        ids[~of_odd] = joined[joined != self.cut_id]
        ids[of_odd] = [i for k in odd for i in out[k]]
        return ids, sizes

    def _put(self, words: pa.Array, is_letters: pa.Array) -> np.ndarray:
        """Add words that are not known; their places."""
        n, order = len(self.known), np.arange(len(words))
        found = self._ids_of_letters(words.filter(is_letters).to_pylist()) if self.plain is not None else None
        if found is not None:
            order = np.argsort(~is_letters.to_numpy(zero_copy_only=False), kind="stable")
            self._add(words.filter(is_letters), *found)
            words = words.filter(pc.invert(is_letters))
        self._add(words, *self._ids_of([w.decode("utf-8", "replace") for w in words.to_pylist()]))
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(n, n + len(order))
        return places

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, more = len(self.known), len(ids)
        while self.used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + more] = ids
        self.starts[n : n + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += more
        self.known = pa.concat_arrays([self.known, words])

    def encode(self, texts: list[bytes], piece: int = 6 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts after the other, and how many each has."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= piece):
                size += len(texts[hi]) + 1
                hi += 1
            ids, counts = self._encode(texts[lo:hi])
            if ids[: counts[0]].tolist() != self.tokenizer.encode(texts[lo].decode("utf-8", "replace"), add_special_tokens=False).ids:
                raise ValueError("this tokenizer looks across words")
            yield ids, counts
            lo = hi

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = b"\n".join([*texts, b""])
        kind = np.frombuffer(bytearray(data.translate(_KIND)), np.uint8)
        given = np.frombuffer(data, np.uint8)
        lead = _letters(given)
        kind[lead] = kind[lead + 1] = 2
        inside = kind > 0
        # A word ends at white space, and where a letter or digit and one of .,;:!?#$%&* meet.
        cut = (kind[1:] ^ kind[:-1]) == _MEET
        begin, end = np.empty(len(kind), bool), np.zeros(len(kind), bool)
        begin[0], begin[1:] = inside[0], inside[1:] & (~inside[:-1] | cut)
        end[:-1] = inside[:-1] & (~inside[1:] | cut)
        starts = np.flatnonzero(begin)
        sizes = np.flatnonzero(end) + 1 - starts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        given = given[inside]
        # Capitals are folded here, but not before what may be a mark that joins them, nor in words that may be special tokens.
        after = np.append(given[1:], np.uint8(0))
        plain = given + (((given - np.uint8(65) < 26) & ((after < 128) | (after == 0xC3))).view(np.uint8) << 5)
        for k in set((np.searchsorted(offsets, np.flatnonzero(given == ord("<")), "right") - 1).tolist()):
            plain[offsets[k] : offsets[k + 1]] = given[offsets[k] : offsets[k + 1]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(plain)]).dictionary_encode()
        distinct = words.dictionary
        if len(self.known) + len(distinct) > _KEPT:
            self._clear()
        of_word = pc.index_in(distinct, value_set=self.known)
        new = of_word.is_null()
        of_word = of_word.fill_null(0).to_numpy(zero_copy_only=False).copy()
        if len(fresh := distinct.filter(new)):
            of_word[new.to_numpy(zero_copy_only=False)] = self._put(fresh, _of_letters(fresh))
        ends = np.append(self.starts[: len(self.known)], self.used).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.ids[: self.used])).take(pa.array(of_word[words.indices.to_numpy()]))
        ends_of = lists.offsets.to_numpy()
        ids = lists.flatten().to_numpy()
        last_words = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts]))
        return ids, np.diff(ends_of[last_words].astype(np.int64), prepend=0)


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker, so that words are encoded once."""
    return WordIds(path)


def pack_file(ids: np.ndarray, docs: np.ndarray, known: np.ndarray, lengths: np.ndarray, block: int = 1024) -> Iterator[bytes]:
    """The bytes of a file in parts: ids of all its documents (one or more), their doc_ids, whether those are known, how many ids each has."""
    seen = np.bincount(ids)
    order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    place = np.zeros(len(seen), np.int32)
    place[order] = np.arange(len(order))
    shares = np.add.reduceat(seen[order], classes(len(order))[0])
    shares = (shares * 64 // len(ids) + 1).astype(np.uint32)
    head = pack(order.astype(np.uint32), shares)
    yield _HEAD.pack(_MAGIC, block, len(order), len(ids), len(head)) + head
    n = -(-len(ids) // block)
    ranks = np.zeros(n * block, np.int32)
    ranks[: len(ids)] = place[ids]
    ranks = ranks.reshape(n, block)
    sizes = np.zeros(n, np.uint32)
    for lo, hi in _batches(0, n):
        codes = encode(ranks[lo:hi], len(order), shares)
        sizes[lo : lo + len(codes)] = [len(x) for x in codes]
        yield b"".join(codes)
    plain = ids.astype("<u4")
    sums = np.array([zlib.crc32(plain[i : i + block].tobytes()) for i in range(0, len(ids), block)], np.uint32)
    foot = pack(sizes, sums, docs.astype(np.int64), known.astype(np.uint8), lengths.astype(np.uint64))
    yield foot + _TAIL.pack(len(foot), zlib.crc32(head + foot), _MAGIC)


class IdFile:
    """A file of ids that is open for reading: documents, and any stretch of ids."""

    def __init__(self, source):
        self.source, size = source, source.size()
        magic, self.block, self.n_ranks, self.n_ids, head_size = _HEAD.unpack(source.read_at(_HEAD.size, 0))
        foot_size, crc, end = _TAIL.unpack(source.read_at(_TAIL.size, size - _TAIL.size))
        head, foot = source.read_at(head_size, _HEAD.size), source.read_at(foot_size, size - _TAIL.size - foot_size)
        if (magic, end) != (_MAGIC, _MAGIC) or zlib.crc32(head + foot) != crc:
            raise ValueError("not a whole file of ids")
        self.alphabet, self.shares = unpack(head)
        self.sizes, self.sums, self.docs, self.known, lengths = unpack(foot)
        self.lengths = lengths.astype(np.int64)
        self.at = _HEAD.size + head_size + np.concatenate(([0], np.cumsum(self.sizes.astype(np.int64))))

    def blocks(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids of blocks first to last - 1, some blocks at a time; each block is held against its checksum."""
        for lo, hi in _batches(first, last):
            data = self.source.read_at(int(self.at[hi] - self.at[lo]), int(self.at[lo]))
            cuts = (self.at[lo : hi + 1] - self.at[lo]).tolist()
            ranks = decode([data[i:j] for i, j in zip(cuts, cuts[1:])], self.block, self.n_ranks, self.shares)
            ids = self.alphabet[ranks].reshape(-1)[: self.n_ids - lo * self.block].astype("<u4", copy=False)
            for b in range(lo, hi):
                if zlib.crc32(ids[(b - lo) * self.block : (b - lo + 1) * self.block].tobytes()) != self.sums[b]:
                    raise ValueError(f"block {b} does not match its checksum")
            yield ids

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of the file, from the blocks that hold them."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first = start // self.block
        ids = np.concatenate(list(self.blocks(first, -(-stop // self.block))))
        return ids[start - first * self.block : stop - first * self.block]


def _write(folder: str, tokenizer: str, end_id: int, file_ids: int, block: int):
    def write(batches):
        task = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        words, seq = word_ids(tokenizer), 0
        ids, docs, lengths, waiting = [], [], [], 0

        def flush():
            nonlocal seq, waiting
            name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}.bin"
            known = np.array([x is not None for x in docs])
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                for part in pack_file(np.concatenate(ids), np.array([x or 0 for x in docs], np.int64), known, np.concatenate(lengths), block):
                    out.write(part)
            row = [[task.partitionId()], [seq], [f"{folder}/{name}"], [waiting], [len(docs)]]
            for x in (ids, docs, lengths):
                x.clear()
            seq, waiting = seq + 1, 0
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], ["part", "seq", "path", "n_ids", "n_docs"])

        for batch in batches:
            keys, done = batch["doc_id"].to_pylist(), 0
            for found, counts in words.encode(encoded(batch["text"]), min(6 << 20, 4 * file_ids)):
                ids.append(np.insert(found, np.cumsum(counts), end_id))
                lengths.append(counts + 1)
                docs += keys[done : done + len(counts)]
                done += len(counts)
                waiting += len(ids[-1])
                if waiting >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return write


def _parts(docs: DataFrame, part_mb: int) -> int:
    """Partitions of about part_mb of text; where the size is unknown, texts are measured."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = (docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // 2
    return max(1, -(-size * 2 // (part_mb << 20)))


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, part_mb: int = 24, file_ids: int = 6_000_000, block: int = 1024) -> DataFrame:
    """Write the ids of docs(doc_id, text) in ascending doc_id and return the index: a row per file, with the ids before it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    order = ["doc_id", F.xxhash64("text")]
    # A third of all rows may be equal: a fixed random number deals them out too.
    dealt = plain.withColumn("_deal", F.rand(13)).repartitionByRange(_parts(plain, part_mb), *order, "_deal").sortWithinPartitions(*order)
    files = materialize(dealt.select("doc_id", "text").mapInArrow(_write(folder, tokenizer, end_id, file_ids, block), _INDEX), "ids-index")
    # One row per file of millions of ids.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for name, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
            fs, path = pyarrow.fs.FileSystem.from_uri(name)
            with fs.open_input_file(path) as source:
                file = IdFile(source)
                data = memoryview(b"".join(x.tobytes() for x in file.blocks(0, len(file.sizes))))
            ends = np.cumsum(file.lengths)
            begins = ends - file.lengths
            sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(begins.tolist(), ends.tolist())]
            docs = pa.array(file.docs, pa.int64(), mask=file.known == 0)
            yield pa.RecordBatch.from_arrays([docs, *[pa.array(c, k) for c, k in zip((begins + start, file.lengths, sums), kinds[1:])]], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(index: DataFrame) -> DataFrame:
    """Per document of the files that an index names: doc_id, start, n_tokens and CRC-32 of its ids, all from the files."""
    spread = index.repartition(max(1, 2 * index.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_ids(write_ids(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
