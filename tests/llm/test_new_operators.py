"""Collocations, hard negatives and token ids against brute force and exact round trips, and on awkward tables."""

import collections
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.compare import database, difference
from tidemark.llm import registry
from tidemark.llm.collocations import _send, _summed, _tell, _texts, _told, _Words, collocations, frequent_phrases, pieces_of
from tidemark.llm.common import delta, pack, unpack
from tidemark.llm.hard_negatives import hard_negatives, integers
from tidemark.llm.range_coder import classes, decode, encode
from tidemark.llm.substring_dedup import brute_force, dedup_substrings
from tidemark.llm.token_ids import IdFile, WordIds, pack_file, read_ids, write_ids

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Extra columns whose names the operators use inside.
CLASHING = "chunk int, bucket int, piece string, m long, phrase string, score double, rank int, key long, vector string, start long, id long"
EXTRA = [None] * 11


@pytest.mark.parametrize("name", ["op11_collocations", "op12_hard_negatives"])
def test_twins(spark, name):
    assert difference(registry.QUERIES[name](spark, SF), database(SF), registry.ORACLES[name]) == ""


# Substrings.


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_of_equal_polynomial_are_told_apart(spark):
    """Thue-Morse words and their complements have one polynomial modulo 2^64, whatever its base."""
    one, other = thue_morse(4096), thue_morse(4096).translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest[3:]}"), (3, f"w0 {one}")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: found[:2] for i, found in brute_force(rows).items()} and got[2][1] == 0


# Collocations.


def phrases_by_hand(rows, least, longest=5):
    """lang to phrase to count, by direct search."""
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for mark in ".,;:!?\n\x0b\x0c\r":
            text = text.replace(mark, "\0")
        for piece in text.split("\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][" ".join(words[i : i + n])] += 1
    return {k: {p: n for p, n in c.items() if n >= least} for k, c in counts.items()}, totals


def collocations_by_hand(rows, least, top):
    found, totals = phrases_by_hand(rows, least)
    out = []
    for lang, counts in found.items():
        told = []
        for phrase, a in counts.items():
            words = phrase.split(" ")
            if len(words) < 2 or any(f" {phrase} " in f" {p} " and p != phrase and n >= a for p, n in counts.items()):
                continue
            cuts = [(1000 * a * totals[lang] // (counts[" ".join(words[:k])] * counts[" ".join(words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            told.append((phrase, a, counts[" ".join(words[:k])], counts[" ".join(words[k:])], totals[lang], score))
        told.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(told[:top])]
    return sorted(out)


def text_rows():
    rng = random.Random(5)
    some = ["new york city", "NEW York", "ice cream", "the", "the ice", "é ü", "of the new york city hall", "a\tb  a", "x\x1fy", "ﬁn de", "日本 語"]
    rows = [("".join(rng.choice(some) + rng.choice([" ", ", ", ".", "\n", "\t", "! "]) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(120)]
    return rows + [rows[0]] * 7 + [(None, "en"), ("", "en"), (" \t,.", "fr"), ("word " * 20000, "de")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, x, *EXTRA) for i, (t, x) in enumerate(rows)], f"doc_id long, text string, lang string, {CLASHING}")


@pytest.mark.parametrize("least,top", [(5, 2000), (12, 7)])
def test_collocations_match_brute_force(spark, least, top):
    rows = text_rows()
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations(docs_of(spark, rows), least=least, top=top).collect())
    assert got == collocations_by_hand(rows, least, top) and len(got) > 10


def test_phrases_over_several_chunks_and_a_small_database(spark):
    """Chunks of a megabyte, so counts meet from several, and a database that has to spill."""
    rng = random.Random(6)
    rows = [(" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(4000)) + ".", "en") for _ in range(400)]
    found = frequent_phrases(pieces_of(docs_of(spark, rows)), least=400, chunk_mb=1, memory_mb=64)
    assert {(r["lang"], r["phrase"]): r["f"] for r in found.collect()} == {(k, p): n for k, c in phrases_by_hand(rows, 400)[0].items() for p, n in c.items()}


def test_a_chunk_is_worked_on_in_little_memory():
    """Bytes a word while hashes are sent, where every n-gram is frequent: 108 at most, and 158 when hashes of all places were sorted with their indices."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in rng.integers(0, 1 << 40, 40_000)]
    pieces = [" ".join(names[i] for i in (rng.random(9) ** 3 * len(names)).astype(int)) for _ in range(30_000)]
    table = pa.table({"lang": ["en", "de"] * 15_000, "piece": pieces, "m": pa.repeat(pa.scalar(1, pa.int64()), 30_000), "chunk": pa.repeat(pa.scalar(0, pa.int32()), 30_000)})
    words = sum(len(x.split()) for x in pieces)

    def peak(f, *args):
        tracemalloc.start()
        try:
            out = f(*args)
            return out, tracemalloc.get_traced_memory()[1] / words
        finally:
            tracemalloc.stop()

    def answered(sent):
        return sent.set_column(3, "payload", pa.array([pack(delta(np.cumsum(unpack(x)[0]) << np.uint64(16))) for x in sent["payload"].to_pylist()]))

    sent, most = peak(_send(1, 5, 4), table)
    answers = answered(sent)
    for round_ in (2, 3):
        sent, size = peak(_send(round_, 5, 4), table, answers)
        answers, most = pa.concat_tables([answers, answered(sent)]), max(most, size)
    told, size = peak(_tell(5, 4), table, answers)
    assert told.num_rows and most < 125 and size < 250, (most, size)


def test_weights_of_equal_hashes_are_summed_at_any_size():
    h = np.array([5, 3, 5, 3, 9, 5], np.uint64) << np.uint64(16)
    keys, sums = _summed(h, np.array([1, 65535, 1 << 40, 65536, 7, 65535], np.int64))
    assert (keys >> np.uint64(16)).tolist() == [3, 5, 9] and sums.tolist() == [131071, (1 << 40) + 65536, 7]
    assert [len(x) for x in _summed(h[:0], np.zeros(0, np.int64))] == [0, 0]


def test_phrases_of_equal_hashes_are_told_apart():
    pieces = ["a b", "c d", "a b x", "c d y"]
    words = _Words(pa.table({"lang": ["en"] * 4, "piece": pieces, "m": pa.array([1, 10, 100, 1000])}))
    at = np.array([0, 2, 4, 7])
    for h in ([1, 1, 1, 1], [1, 2, 1, 2]):
        places, _, weight = _told(words, at, np.array(h, np.uint64), 2)
        assert dict(zip(_texts(words, places, 2).to_pylist(), weight.tolist())) == {"a b": 101, "c d": 1010}


def test_collocations_of_nothing(spark):
    assert collocations(docs_of(spark, [])).count() == 0
    assert collocations(docs_of(spark, [(None, None), ("", "en")])).count() == 0


# Hard negatives.


def negatives_by_hand(rows, every=50):
    rows = [(i, x, [int(np.floor(256 * float(c))) for c in v]) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    rows = list({(i, x, tuple(v)) for i, x, v in rows})
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted(((sum(a * b for a, b in zip(v, w)), j, x) for j, x, w in rows if j != i), key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            near = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, k + 1, n[1], p, n[0]) for k, n in enumerate(near)]
    return sorted(out)


def vectors(rng, n, dim=6, spread=1.0):
    return [(i, rng.randrange(4), [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)]) for i in range(n)]


def mined(spark, rows, **sizes):
    table = spark.createDataFrame([(*r, *EXTRA) for r in rows], f"vec_id long, label int, embedding array<float>, {CLASHING}")
    return sorted(tuple(r) for r in hard_negatives(integers(table), "id % 50 = 0", **sizes).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed,spread,blocks", [(1, 1.0, {}), (2, 0.05, {"row_block": 64, "anchor_block": 2}), (3, 300.0, {"row_block": 100, "anchor_block": 1})])
def test_negatives_match_brute_force(spark, seed, spread, blocks):
    rows = vectors(random.Random(seed), 401, spread=spread)
    want = negatives_by_hand(rows)
    assert mined(spark, rows, **blocks) == want and len(want) > 20


def test_negatives_of_awkward_rows(spark):
    """Nulls, values that are not finite, shorter vectors, zeros, repeated rows and ties."""
    rng = random.Random(4)
    rows = vectors(rng, 120)
    same = [(200 + i, i % 3, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]  # one vector many times: only ties
    odd = [(300, None, [1.0] * 6), (None, 1, [1.0] * 6), (301, 1, None), (302, 1, [1.0, None] * 3), (303, 1, [float("nan")] * 6), (350, 1, [float("inf")] * 6), (400, 2, [1.0, 1.0]), (450, 2, []), (500, 2, [0.0] * 6), rows[0], rows[50], rows[7]]
    want = negatives_by_hand([(i, x, (v + [0.0] * 6)[:6] if v else [0.0] * 6 if v == [] else v) for i, x, v in rows + same + odd])
    assert mined(spark, rows + same + odd) == want == mined(spark, rows + same + odd, row_block=16, anchor_block=1)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, 1, [1.0])]) == []


# Token ids.


@pytest.mark.parametrize("ranks", [1, 2, 3, 5, 70, 5000])
def test_coder_round_trip(ranks):
    rng = np.random.default_rng(ranks)
    for blocks, length in ((1, 1), (3, 17), (40, 700)):
        ids = np.minimum((rng.pareto(0.8, (blocks, length)) * 2).astype(np.int64), ranks - 1).astype(np.int32)
        ids[0] = ids[0][0]  # a block of one id
        if blocks > 2:
            ids[1] = np.resize(np.arange(min(ranks, 7)), length)  # and a cycle
        shares = np.ones(len(classes(ranks)[0]), np.uint32)
        codes = encode(ids, ranks, shares)
        assert (decode(codes, length, ranks, shares) == ids).all()
        assert (decode(codes[-1:], length, ranks, shares) == ids[-1:]).all()  # a block alone


def test_coder_learns():
    """A cycle costs less than half a bit an id, which only the higher orders can tell, and random ids little more than their entropy."""
    ids = np.resize(np.random.default_rng(0).integers(0, 200, 97), 4096).astype(np.int32)[None]
    shares = np.ones(len(classes(200)[0]), np.uint32)
    assert len(encode(ids, 200, shares)[0]) * 8 < 0.7 * 4096 + 97 * 8
    rnd = np.random.default_rng(1).integers(0, 200, (8, 4096)).astype(np.int32)
    assert sum(map(len, encode(rnd, 200, shares))) * 8 < 1.08 * np.log2(200) * rnd.size


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


def test_file_reads_any_stretch_and_tells_of_damage():
    ids = np.random.default_rng(2).integers(0, 3000, 5000).astype(np.int32)
    data = b"".join(pack_file(ids, np.array([4, 9]), np.array([True, False]), np.array([10, 4990]), block=256))
    file = IdFile(Bytes(data))
    for start, stop in ((0, 5000), (0, 1), (255, 257), (4999, 9999), (300, 300)):
        assert (file.read(start, stop) == ids[start:stop]).all()
    for at in (len(data) // 2, 40, len(data) - 30):
        with pytest.raises(ValueError):
            broken = IdFile(Bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]))
            list(broken.blocks(0, len(broken.sizes)))


def direct(rows):
    tokenizer, at, out = Tokenizer.from_file(WORDS), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_words_alone_have_the_ids_of_whole_texts():
    rng, tokenizer = random.Random(1), Tokenizer.from_file(WORDS)
    texts = ["", "a <|endoftext|>b <|endof<|endoftext|> <|startoftext|> <|ENDOFTEXT|>", "don't I'LL ' IT'S. 'S,x", "W̊ T̈ İ Y̊ ΣΑΣ Σ ﬁ ½ »a A.»", "v3.14,a...B!?c ;d:E", "x" * 3000]
    texts += ["".join(rng.choice("aB'sST.,!? \t\né̊́WwI1\x00<|>… 中") for _ in range(rng.randrange(40))) for _ in range(3000)]
    got = []
    for ids, counts in WordIds(WORDS).encode([t.encode() for t in texts], piece=1 << 12):
        got += np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_of_letters_are_spared_the_rules_before_the_model():
    text, seen = "Leque### Élan,ÿé.Straße$$$ don't W̊ 12ab <|endoftext|> Œuf ×a", []
    words = WordIds(WORDS)
    whole = words._ids_of
    words._ids_of = lambda w: seen.extend(w) or whole(w)
    ((ids, _),) = words.encode([text.encode()])
    assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted(["###", ",", ".", "$$$", "don't", "W̊", "12ab", "<|endoftext|>", "Œuf", "×a"])


def told(df):
    return [tuple(r) for r in df.orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]


def test_ids_of_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = direct([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert told(registry.QUERIES["op13_token_ids"](spark, SF)) == want
    index = write_ids(docs, WORDS, file_ids=20_000, block=128)
    assert index.count() > 3 and told(read_ids(index)) == want


def test_ids_of_awkward_rows(spark):
    """Null and empty texts, a long one, null ids, rows that share an id or are equal, columns of clashing names."""
    rows = [(3, "b c"), (1, None), (2, ""), (5, "word, " * 30000), (4, "same"), (4, "same"), (7, "One."), (7, "another"), (None, "no id"), (None, None), (-2, "minus")]
    got = told(read_ids(write_ids(spark.createDataFrame([(*r, "en", *EXTRA) for r in rows], f"doc_id long, text string, lang string, {CLASHING}"), WORDS)))
    want = direct(rows)
    key = lambda x: (x[0] is not None, x[0] or 0, x[2:])
    assert [x[0] for x in got] == [x[0] for x in want] and sorted(map(key, got)) == sorted(map(key, want))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:])) and got[0][1] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert read_ids(write_ids(empty, WORDS)).count() == 0


def test_colliding_words_are_no_near_duplicates(spark):
    """Texts that differ in one of 21 words share too few shingles, also where the words have one polynomial modulo 2^64; equal ones are found."""
    from tidemark.llm.decontaminate import find_contamination
    from tidemark.llm.minhash_dedup import near_duplicates

    one, other = thue_morse(4096), thue_morse(4096).translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(20)]
    text = lambda word: " ".join([*words[:10], word, *words[10:]])
    rows = [(1, text(one)), (2, text(other)), (3, text(one).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    item = spark.createDataFrame([(7, " ".join([*words[4:10], one, *words[10:16]]))], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in find_contamination(docs, item).collect()}
    assert got == {1: 13, 2: 0, 3: 13}
