"""Collocations: frequent phrases that score well against their parts.

Texts are split into pieces, and identical pieces are counted first, so a line that thousands of documents share is
looked at once. Distinct pieces are spread in chunks. In three rounds (words; pairs of frequent words; three to five
words of frequent pairs) each chunk sends hashes of its n-grams with their weights to hash buckets, duckdb sums them
there (out of core: it spills beyond a fixed memory), and the bucket answers each chunk which of its hashes are
frequent. Words that are rare, most of a vocabulary, never enter a longer n-gram.

Hashes only preselect. Chunks then send the text of each n-gram that was answered, counted by its exact words, to the
buckets, where duckdb sums texts and keeps what is frequent, so a collision of hashes changes no result. A phrase asks for its parts'
counts by shuffled lookups (a join by part) and gathers the answers by phrase.

Null texts are empty and have no pieces, a null lang is ``und``. Ties in score go to the larger count, then to the
phrase in UTF-8 byte order. Very long pieces stay whole, in one chunk. Empty tables give no rows; repeated rows count
as often as they are there; other columns are not looked at. Products of counts are decimals of 38 digits.
"""

from __future__ import annotations

import contextlib
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, bucket_cuts, delta, load, materialize, mix, pack, unpack

_ANSWER = "chunk int, bucket int, level int, payload binary"
_BASE = 0x9E3779B97F4A7C15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces_of(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by one space) and its multiplicity m, for docs(lang, text)."""
    split = F.explode(F.split(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), r"[.,;:!?\x0A-\x0D]"))
    piece = F.trim(F.regexp_replace(F.col("piece"), r"[\x20\x09]+", " "))
    pieces = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), split.alias("piece")).select("lang", piece.alias("piece"))
    return pieces.where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


class _Words:
    """The words of a chunk's pieces. Words of one lang that are equal share a number; a place is a word's position in the chunk."""

    def __init__(self, table: pa.Table):
        binary = pa.large_binary()
        lines = pc.binary_join_element_wise(table["piece"].cast(binary), pa.scalar(b"", binary), pa.scalar(b"\n", binary)).combine_chunks()
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        self.data = np.frombuffer(lines.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        small = np.int32 if len(self.data) < 1 << 31 else np.int64
        inside = (self.data != 32) & (self.data != 10)
        step = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = (np.flatnonzero(step == x).astype(small) for x in (1, -1))
        #: The last place of each piece and one more, and the piece of each place.
        self.stops = np.searchsorted(self.starts, (offsets[1:] - offsets[0]).astype(small))
        counts = np.diff(self.stops, prepend=0)
        self.piece = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        ends = np.cumsum(self.ends - self.starts, dtype=np.int64)
        given = self.data[inside]
        del lines, step, inside
        words = pa.LargeBinaryArray.from_buffers(binary, len(self.starts), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(given)]).dictionary_encode()
        del ends, given
        langs = table["lang"].combine_chunks().dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        number = langs.indices.to_numpy()[self.piece].astype(np.int32 if len(words.dictionary) * len(self.langs) < 1 << 31 else np.int64)
        number += words.indices.to_numpy() * number.dtype.type(len(self.langs))
        number = pa.array(number).dictionary_encode()
        self.number, pairs = number.indices.to_numpy(), number.dictionary.to_numpy()
        self.m = table["m"].to_numpy()
        # By number: its lang, the hash of its word.
        self.lang = pairs % len(self.langs)
        self.hash = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], U64)[pairs // len(self.langs)]
        self.salt = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in self.langs], U64)

    def _salted(self, raw: np.ndarray, lang: np.ndarray, n: int) -> np.ndarray:
        raw += self.salt[lang] * U64(2 * n + 1)
        return mix(raw) >> U64(16) << U64(16)

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each number, of which 48 bits count, and its weight."""
        weight = np.zeros(len(self.lang), np.int64)
        np.add.at(weight, self.number, self.m[self.piece])
        return self._salted(self.hash.copy(), self.lang, 1), weight

    def grams(self, n: int, at: np.ndarray) -> np.ndarray:
        """A hash of the n words from each place on, of which 48 bits count."""
        raw = np.zeros(len(at), U64)
        for j in range(n):
            raw *= U64(_BASE)
            raw += self.hash[self.number[at + j]]
        return self._salted(raw, self.lang[self.number[at]], n)


def _summed(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, and the sum of its weights. Small weights go through the sort in the 16 bits that hashes leave free."""
    large = np.flatnonzero(weight >> 16)
    keys = h | weight.astype(U64)
    keys[large] = h[large]
    keys.sort()
    sums = keys & U64(0xFFFF)
    keys ^= sums
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    keys, sums = keys[first], np.add.reduceat(sums, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    np.add.at(sums, np.searchsorted(keys, h[large]), weight[large])
    return keys, sums


def _frequent(answers: pa.Table | None) -> dict[int, np.ndarray]:
    """By level: the hashes of a chunk that were answered, in order."""
    found: dict[int, list[np.ndarray]] = {}
    for payload, level in zip(answers["payload"].to_pylist(), answers["level"].to_pylist()) if answers else ():
        found.setdefault(level, []).append(np.cumsum(unpack(payload)[0]))
    return {level: np.sort(np.concatenate(x)) for level, x in found.items()}


def _within(values: np.ndarray, among: np.ndarray | None) -> np.ndarray:
    if among is None or not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _candidates(words: _Words, known: dict[int, np.ndarray], longest: int):
    """(n, places, hashes) of n-grams by n: pairs of frequent words; then more words whose pairs are all frequent."""
    single = _within(words.singles()[0], known.get(1))[words.number]
    at = np.flatnonzero(single[:-1] & single[1:] & (words.piece[:-1] == words.piece[1:]))
    h = words.grams(2, at)
    yield 2, at, h
    at = at[_within(h, known.get(2))]
    pair = np.zeros(len(single), bool)
    pair[at] = True
    for n in range(3, longest + 1):
        at = at[at + n <= words.stops[words.piece[at]]]
        at = at[pair[at + n - 2]]
        yield n, at, words.grams(n, at)


def _send(round_: int, longest: int, buckets: int):
    """Hashes of a round's n-grams in a chunk, each once with its weight, by hash bucket."""

    def sums(words: _Words, answers: pa.Table | None):
        if round_ == 1:
            yield 1, *_summed(*words.singles())
            return
        for n, at, h in _candidates(words, _frequent(answers), 2 if round_ == 2 else longest):
            if n >= round_:
                yield n, *_summed(h, words.m[words.piece[at]])

    def send(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        rows = []
        if table.num_rows:
            chunk = table["chunk"][0].as_py()
            for n, h, weight in sums(_Words(table), answers):
                cuts = bucket_cuts(h, buckets)
                rows += [(chunk, b, n, pack(delta(h[i:j] >> U64(16)), weight[i:j].astype(U64))) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
        return _rows(rows)

    return send if round_ > 1 else lambda table: send(table, None)


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.int32(), pa.int32(), pa.binary()])], ["chunk", "bucket", "level", "payload"])


@contextlib.contextmanager
def _database(memory_mb: int):
    """A database of this task; what does not fit its memory is spilled into a folder that goes with it."""
    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill, "preserve_insertion_order": False}) as db:
        yield db


def _insert(db, name: str, rows: pa.Table) -> None:
    db.register("part", rows)
    db.execute(f"INSERT INTO {name} SELECT * FROM part")
    db.unregister("part")


def _sum(least: int, memory_mb: int):
    """In a hash bucket: which hashes of each chunk have a weight of least or more over all chunks."""

    def frequent(table: pa.Table) -> pa.Table:
        bucket, rows = table["bucket"][0].as_py(), []
        chunks, levels, payloads = (table[c].to_pylist() for c in ("chunk", "level", "payload"))
        with _database(memory_mb) as db:
            db.execute("CREATE TABLE sent (level INTEGER, h UBIGINT, weight BIGINT)")
            for level, payload in zip(levels, payloads):
                h, weight = unpack(payload)
                part = pa.table({"level": pa.repeat(pa.scalar(level, pa.int32()), len(h)), "h": np.cumsum(h), "weight": weight.astype(np.int64)})
                _insert(db, "sent", part)
            found = db.execute(f"SELECT level, h FROM sent GROUP BY level, h HAVING sum(weight) >= {least}").fetchnumpy()
        by_level = {n: np.sort(found["h"][found["level"] == n]) for n in set(levels)}
        for chunk, level, payload in zip(chunks, levels, payloads):
            h = np.cumsum(unpack(payload)[0])
            h = h[_within(h, by_level[level])]
            if len(h):
                rows.append((chunk, bucket, level, pack(delta(h << U64(16)))))
        return _rows(rows)

    return frequent


def _exact(words: _Words, at: np.ndarray, n: int) -> np.ndarray:
    """A number for the n words from each place on, the same for the same words of the same lang only."""
    key = words.number[at].astype(np.int64)
    for j in range(1, n):
        _, key = np.unique(key * len(words.lang) + words.number[at + j], return_inverse=True)
    return key


def _told(words: _Words, at: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes (in order) and weights of the distinct n-grams among those at some places, told apart by their words."""
    order = np.argsort(h, kind="stable")
    at, h = at[order], h[order]
    new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    first = at[new][np.cumsum(new) - 1]
    weight = words.m[words.piece[at]]
    if all(np.array_equal(words.number[at + j], words.number[first + j]) for j in range(n)):
        return at[new], h[new], np.add.reduceat(weight, np.flatnonzero(new)) if len(at) else weight
    # Other words of the same hash.
    _, first, which = np.unique(_exact(words, at, n), return_index=True, return_inverse=True)
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, which, weight)
    order = np.argsort(first)
    return at[first[order]], h[first[order]], sums[order]


def _texts(words: _Words, at: np.ndarray, n: int) -> pa.Array:
    """The n words from each place on, as text."""
    starts, sizes = words.starts[at].astype(np.int64), words.ends[at + n - 1] - words.starts[at]
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    raw = np.empty(int(offsets[-1]), np.uint8)
    for lo in range(0, len(at), 1 << 14):
        hi = min(lo + (1 << 14), len(at))
        raw[offsets[lo] : offsets[hi]] = words.data[np.repeat(starts[lo:hi] - offsets[lo:hi], sizes[lo:hi]) + np.arange(offsets[lo], offsets[hi])]
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    try:
        return texts.cast(pa.large_string())
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.large_string())


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _tell(longest: int, buckets: int):
    """Texts and weights of a chunk's n-grams whose hashes are frequent, by hash bucket."""

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if table.num_rows and answers.num_rows:
            words, known, chunk = _Words(table), _frequent(answers), table["chunk"][0].as_py()
            langs = pa.array(words.langs, pa.string())

            def told(n: int, at: np.ndarray, h: np.ndarray, weight: np.ndarray) -> None:
                cuts = bucket_cuts(h, buckets)
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if j > i:
                        cols = [langs.take(pa.array(words.lang[words.number[at[i:j]]])), pa.repeat(pa.scalar(n, pa.int32()), j - i), _texts(words, at[i:j], n), pa.array(weight[i:j])]
                        rows.append((chunk, b, n, _packed(pa.table(cols, ["lang", "words", "phrase", "weight"]))))

            h, weight = words.singles()
            number = np.flatnonzero(_within(h, known.get(1)))
            number = number[np.argsort(h[number])]
            place = np.empty(len(words.lang), np.int64)
            place[words.number] = np.arange(len(words.number))
            told(1, place[number], h[number], weight[number])
            for n, at, h in _candidates(words, known, longest):
                kept = _within(h, known.get(n))
                at, h, weight = _told(words, at[kept], h[kept], n)
                told(n, at, h, weight)
        return _rows(rows)

    return tell


def _count(least: int, memory_mb: int):
    """In a hash bucket: the phrases of a weight of least or more over all chunks, by their texts."""

    def count(table: pa.Table) -> pa.Table:
        with _database(memory_mb) as db:
            db.execute("CREATE TABLE told (lang VARCHAR, words INTEGER, phrase VARCHAR, weight BIGINT)")
            for payload in table["payload"].to_pylist():
                _insert(db, "told", pa.ipc.open_stream(payload).read_all())
            found = db.execute(f"SELECT lang, words, phrase, CAST(sum(weight) AS BIGINT) AS f FROM told GROUP BY ALL HAVING sum(weight) >= {least}").fetchall()
        cols = list(zip(*found)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.int32(), pa.string(), pa.int64()])], ["lang", "words", "phrase", "f"])

    return count


def frequent_phrases(pieces: DataFrame, least: int = 100, longest: int = 5, chunk_mb: int = 16, memory_mb: int = 256) -> DataFrame:
    """lang, words, phrase and f of all phrases of up to ``longest`` words that occur ``least`` times or more in pieces(lang, piece, m)."""
    size = pieces.agg(F.sum(F.octet_length("piece") + 1).alias("n")).first()["n"] or 0
    chunks = max(1, -(-size // (chunk_mb << 20)))
    by_chunk = pieces.select("lang", "piece", "m", F.pmod(F.xxhash64("lang", "piece"), F.lit(chunks)).cast("int").alias("chunk")).groupBy("chunk")

    def count(sent: DataFrame) -> DataFrame:
        return sent.groupBy("bucket").applyInArrow(_sum(least, memory_mb), _ANSWER)

    one = count(by_chunk.applyInArrow(_send(1, longest, chunks), _ANSWER))
    two = count(by_chunk.cogroup(one.groupBy("chunk")).applyInArrow(_send(2, longest, chunks), _ANSWER))
    known = one.unionByName(two)
    more = count(by_chunk.cogroup(known.groupBy("chunk")).applyInArrow(_send(3, longest, chunks), _ANSWER))
    told = by_chunk.cogroup(known.unionByName(more).groupBy("chunk")).applyInArrow(_tell(longest, chunks), _ANSWER)
    return told.groupBy("bucket").applyInArrow(_count(least, memory_mb), "lang string, words int, phrase string, f long")


def _part(first, last):
    """Words first to last - 1 of a phrase, from 0."""
    return F.array_join(F.slice("w", first + 1, last - first), " ")


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases that no longer one of the same count holds.

    grams has all frequent phrases (lang, words, phrase, f), single words too, totals the words n of each lang.
    """
    asked = grams.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # Each cut asks for two parts; a part's count comes back to its phrase and cut.
    zero, n = F.lit(0), F.col("words")
    cuts = asked.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(zero, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("k"), n).alias("part"))))
    requests = cuts.select("lang", "phrase", "a", "k", sides.alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    answers = requests.join(grams.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda x: F.max(F.when(F.col("side") == x, F.col("f"))).alias(x)
    parts = answers.groupBy("lang", "phrase", "a", "k").agg(side("l"), side("r")).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = parts.groupBy("lang", "phrase", "a", "n").agg(least)
    # A phrase inside a longer one of its count is inside one of a single word more of that count.
    longer = asked.where("words > 2").select("lang", "a", F.explode(F.array(_part(zero, n - 1), _part(F.lit(1), n))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").where("longer is null or longer < a")
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, chunk_mb: int = 16) -> DataFrame:
    """The first ``top`` phrases of each lang in docs(lang, text): lang, rank, phrase, a, l, r, n, score."""
    pieces = materialize(pieces_of(docs), "pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("m") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)).alias("n"))
    grams = materialize(frequent_phrases(pieces, least, longest, chunk_mb), "phrases")
    found = scored(grams, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A lang may hold most phrases: its first ones are found in parts before they meet.
    some = found.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS MATERIALIZED (
    SELECT lang, string_split(trim(regexp_replace(x, '[\x20\x09]+', ' ', 'g'), ' '), ' ') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
    WHERE regexp_matches(x, '[^\x20\x09]')),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM pieces, unnest(range(1, len(w) + 1)) t(i), unnest(range(1, 6)) u(k)
    WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2),
cuts AS (
    SELECT c.lang, c.phrase, c.k, c.a, n, j, x.f AS l, y.f AS r, CAST((1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM candidates c CROSS JOIN unnest(range(1, c.k)) t(j) JOIN totals USING (lang)
    JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
    JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
covered AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
    FROM candidates, unnest(range(2, k)) u(m), unnest(range(1, k - m + 2)) t(i) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM cuts LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR longer < a
QUALIFY rank <= 2000
"""
