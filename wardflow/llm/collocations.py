"""Phrase collocation mining: phrases of up to DEPTH words that occur LEAST times or more in a language, scored by their weakest cut.

A shard holds the texts of one language as word codes. Each shard builds a generalised suffix automaton of its pieces,
bounded to DEPTH words: the states are the classes of phrases with the same end positions, with the number of those
positions, the longest phrase of the class and the suffix link. It is built by sorting the positions by the words before them,
which yields the same states and links as adding words one by one; transitions are not kept, as listing the phrases
of each state by its link doesn't follow them. Counts are added up over shards by key, in hash buckets that answer each shard which of its
keys are frequent; the first shard that holds a frequent phrase spells it.

What can't be frequent leaves early, and exactly: a phrase is no more frequent than a word or a pair of words in it. So
the shards ask first for words, then for pairs (automata of depth 2), and build the automata of full depth over the runs in which
all pairs are frequent. Keys are numbers of words and pairs, not hashes. A phrase is dropped as subsumed if one of the
phrases that lead to it by dropping a first word (their suffix link) or a last one has the same count; what has the same count at
a greater distance has it at each step between.

Defined cases: null lang is `und`; null and empty texts have no words; repeated rows count each time; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardflow.llm._chunks import bucket_count, packed, rows, runs, unpacked
from wardflow.llm._util import Workspace, gather, lower_ascii, mix64, pieces, text_bytes, word_spans

DEPTH = 5
LEAST = 100
TOP = 2000
CHUNK_TEXT = 4 << 20
_GAP = np.zeros(256, bool)
_GAP[[9, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[10, 11, 12, 13, *b".,;:!?"]] = True


class SuffixAutomaton:
    """The bounded automaton of a sequence of numbers above 0, in which 0 ends a piece.

    For each state: `end`, a position where its phrases end; `length` of the longest; `shortest`; `endpos`, how many
    positions; `link`, the state of the longest suffix that isn't in it (-1: the empty phrase).
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        ends = np.flatnonzero(symbols)
        back = [symbols[ends].astype(np.uint64)]
        for j in range(1, depth):
            before = np.where(ends >= j, symbols[np.maximum(ends - j, 0)], 0).astype(np.uint64)
            back.append(np.where(back[-1] > 0, before, np.uint64(0)))
        keys = [back[j] << np.uint64(32) | (back[j + 1] if j + 1 < depth else np.uint64(0)) for j in range(0, depth, 2)]
        order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
        ends, n = ends[order], len(ends)
        new, groups, firsts, counts = np.zeros(n, bool), [], [], []
        new[:1] = True
        for d in range(depth):
            column = back[d][order]
            new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            groups.append(np.cumsum(new, dtype=np.int32) - 1)
            counts.append(np.diff(np.append(first, n)))
            firsts.append(first)
            back[d] = column
        self.end, self.length, self.shortest, self.endpos, self.link = [], [], [], [], []
        lows, numbers, total = [], [], 0
        for d in range(depth):
            first, count = firsts[d], counts[d]
            real = back[d][first] > 0
            low = np.full(len(first), d + 1, np.int8)
            if d:
                above = groups[d - 1][first]
                same = counts[d - 1][above] == count
                low[same] = lows[d - 1][above][same]
            lows.append(low)
            longest = real.copy()
            if d + 1 < depth:
                longest &= (back[d + 1][first] == 0) | (counts[d + 1][groups[d + 1][first]] != count)
            at = np.flatnonzero(longest)
            number = np.full(len(first), -1, np.int64)
            number[at] = total + np.arange(len(at))
            total += len(at)
            numbers.append(number)
            link = np.full(len(at), -1, np.int64)
            for m in range(1, d + 1):
                down = low[at] == m + 1
                link[down] = numbers[m - 1][groups[m - 1][first[at][down]]]
            for held, more in ((self.end, ends[first[at]]), (self.length, np.full(len(at), d + 1)), (self.shortest, low[at].astype(np.int64)), (self.endpos, count[at]), (self.link, link)):
                held.append(more)
        self.end, self.length, self.shortest, self.endpos, self.link = map(np.concatenate, (self.end, self.length, self.shortest, self.endpos, self.link))

    def phrases(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every phrase of `least` words or more, once: where one ends, its words, and how often it occurs."""
        low = np.maximum(self.shortest, least)
        n = np.maximum(self.length - low + 1, 0)
        state = np.repeat(np.arange(len(n)), n)
        return self.end[state], low[state] + np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n), self.endpos[state]


SHARD = "chunk long, lang string, codes binary, vocabulary binary, n_words long"


def to_shards(docs: DataFrame, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """Texts of one language, about chunk_text bytes, as codes of words (-1 ends a piece) and their vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lang in pc.unique(batch.column("lang")):
                for piece in pieces(batch.filter(pc.equal(batch.column("lang"), lang)), "text", chunk_text):
                    raw, off = text_bytes(piece.column("text"))
                    raw = lower_ascii(raw)
                    starts, ends, before = word_spans(raw, off, _GAP | _STOP)
                    coded = gather(raw, starts, ends).dictionary_encode()
                    stops = np.r_[0, np.cumsum(_STOP[raw])]
                    ahead = np.zeros(len(starts) + 1, bool)
                    ahead[before[1:-1]] = True  # a text begins
                    ahead = ahead[:-1]
                    ahead[1:] |= stops[starts[1:]] != stops[starts[:-1]]
                    codes = np.insert(np.asarray(coded.indices, np.int32), np.flatnonzero(ahead), -1)
                    words = b" ".join(coded.dictionary.cast(pa.large_binary()).to_pylist())
                    yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([lang.as_py()], pa.string()), pa.array([packed(codes)], pa.binary()), pa.array([pa.compress(words, "zstd", asbytes=True)], pa.binary()), pa.array([len(starts)], pa.int64())], ["chunk", "lang", "codes", "vocabulary", "n_words"])
                    seq += 1

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").mapInArrow(run, SHARD)


_SENT = "bucket long, chunk long, lang string, n int, keys binary, more binary, counts binary"
_ANSWER = "chunk long, bucket long, numbers binary, counts binary"


def _sent(row: dict, bucket: np.ndarray, parts: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int64()), "chunk": pa.array([row["chunk"]] * n, pa.int64()), "lang": pa.array([row["lang"]] * n, pa.string()), "n": pa.array([p[0] for p in parts], pa.int32()), **{c: pa.array([p[i] for p in parts], pa.binary()) for i, c in ((1, "keys"), (2, "more"), (3, "counts"))}})


def _answers(table: pa.Table, key: np.ndarray, counts: np.ndarray, n_buckets: int, least: int) -> pa.Table:
    """For the keys (0..) that shards sent to one bucket: the number that a frequent one gets, and its count for the first shard that sent it; else 0."""
    total = np.zeros(int(key.max()) + 1 if len(key) else 0, np.int64)
    np.add.at(total, key, counts)
    often = total >= least
    number = np.where(often, (np.cumsum(often) - 1) * n_buckets + table["bucket"][0].as_py() + 1, 0)
    if len(number) and number.max() >= 1 << 32:
        raise OverflowError("more than 2**32 frequent words or pairs")
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    cuts = np.cumsum(table["n"].to_numpy())[:-1]
    fill = lambda x: pa.array([packed(p) for p in np.split(x, cuts)], pa.binary())
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "numbers": fill(number[key].astype(np.uint32)), "counts": fill(np.where(first, (total * often)[key], 0))})


def _read(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    parts = [np.frombuffer(unpacked(x), kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


class Shard:
    """A shard row, unpacked, with what the buckets have answered so far."""

    def __init__(self, row: dict, n_buckets: int):
        self.n_buckets = n_buckets
        self.codes = np.frombuffer(unpacked(row["codes"]), np.int32)
        self.vocabulary = unpacked(row["vocabulary"]).split(b" ") if row["n_words"] else []
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        self.word_order = np.argsort(bucket, kind="stable")
        self.word_bucket = bucket[self.word_order]

    def words(self) -> tuple[np.ndarray, list]:
        held = list(runs(self.word_bucket))
        counts = np.bincount(self.codes[self.codes >= 0], minlength=len(self.vocabulary))[self.word_order]
        parts = [(j - i, pa.compress(b" ".join(self.vocabulary[x] for x in self.word_order[i:j].tolist()), "zstd", asbytes=True), b"", packed(counts[i:j].astype(np.int64))) for _, i, j in held]
        return np.array([b for b, _, _ in held], np.int64), parts

    def number_words(self, answers: list[dict]) -> None:
        numbers, self.word_counts = _in_order(answers, self.word_bucket)
        number = np.zeros(len(self.vocabulary) + 1, np.int64)  # the last one stands for -1
        number[self.word_order] = numbers
        self.word = number[self.codes]

    def _sorted(self, key: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        bucket = (mix64(key ^ mix64(more)) % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.lexsort((more, key, bucket))
        return order, bucket[order], key[order], more[order], counts[order]

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Distinct pairs in bucket order: where one ends, bucket, key, count."""
        end, _, counts = SuffixAutomaton(self.word, 2).phrases(2)
        key = self.word[end - 1].astype(np.uint64) << np.uint64(32) | self.word[end].astype(np.uint64)
        order, bucket, key, _, counts = self._sorted(key, np.zeros_like(key), counts)
        return end[order], bucket, key, counts

    def number_pairs(self, answers: list[dict]) -> None:
        self.pair_end, bucket, key, _ = self.pairs()
        numbers, self.pair_counts = _in_order(answers, bucket)
        at = np.flatnonzero((self.word[1:] > 0) & (self.word[:-1] > 0)) + 1
        mine = self.word[at - 1].astype(np.uint64) << np.uint64(32) | self.word[at].astype(np.uint64)
        order = np.argsort(key)
        self.pair = np.zeros(len(self.word), np.int64)
        if len(key):
            self.pair[at] = numbers[order][np.searchsorted(key[order], mine)]

    def longer(self) -> tuple[np.ndarray, ...]:
        """Distinct phrases of three words or more in which all pairs are frequent: end, words, bucket, key, second key, count."""
        held = self.pair > 0
        inside = held.copy()
        inside[:-1] |= held[1:]
        # a word that ends one run and begins the next stands twice, with a break between
        begins = np.flatnonzero(inside & ~held)
        place = np.insert(np.flatnonzero(inside), np.searchsorted(np.flatnonzero(inside), begins), -1)
        end, length, counts = SuffixAutomaton(np.where(place < 0, 0, self.word[place]), DEPTH).phrases(3)
        end = place[end]
        start = end - length + 1
        low = np.where(length == 3, self.word[end], self.pair[start + 3 - (length == 3)])
        key = self.pair[start + 1].astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        more = length.astype(np.uint64) << np.uint64(32) | np.where(length == 5, self.word[end], 0).astype(np.uint64)
        order, bucket, key, more, counts = self._sorted(key, more, counts)
        return end[order], length[order], bucket, key, more, counts

    def spelled(self, answers: list[dict]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Phrases that this shard is the first to hold, their number of words and their counts over all shards."""
        end, length, bucket, *_ = self.longer()
        _, counts = _in_order(answers, bucket)
        words = self.word_order[self.word_counts > 0]
        texts = [self.vocabulary[x] for x in words.tolist()]
        at = np.r_[self.pair_end[self.pair_counts > 0], end[counts > 0]]
        sizes = np.r_[np.full((self.pair_counts > 0).sum(), 2), length[counts > 0]]
        texts += [b" ".join(self.vocabulary[c] for c in self.codes[e - k + 1 : e + 1].tolist()) for e, k in zip(at.tolist(), sizes.tolist(), strict=True)]
        return texts, np.r_[np.ones(len(words), int), sizes], np.r_[self.word_counts[self.word_counts > 0], self.pair_counts[self.pair_counts > 0], counts[counts > 0]]


def _in_order(answers: list[dict], bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the shard's keys, which lie in bucket order."""
    got = {a["bucket"]: a for a in answers or ()}
    numbers, counts = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    for b, i, j in runs(bucket):
        numbers[i:j], counts[i:j] = np.frombuffer(unpacked(got[b]["numbers"]), np.uint32), np.frombuffer(unpacked(got[b]["counts"]), np.int64)
    return numbers, counts


def frequent_phrases(docs: DataFrame, space: Workspace, least: int = LEAST, chunk_text: int = CHUNK_TEXT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f): words and phrases of 2 to DEPTH words that occur `least` times; and (lang, n): all words."""
    shards = space.save(to_shards(docs, chunk_text), "shards")
    n = bucket_count(shards)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            yield _sent(row, *Shard(row, n).words())

    def number_words(table: pa.Table) -> pa.Table:
        keys = [f"{lang}\0{w}" for lang, x in zip(table["lang"].to_pylist(), table["keys"].to_pylist(), strict=True) for w in unpacked(x).decode().split(" ")]
        return _answers(table, np.asarray(pa.array(keys, pa.large_string()).dictionary_encode().indices, np.int64), _read(table["counts"], np.int64), n, least)

    def number_keys(table: pa.Table) -> pa.Table:
        key, more = _read(table["keys"], np.uint64), _read(table["more"], np.uint64)
        more = more if len(more) else np.zeros_like(key)
        order = np.lexsort((more, key))
        a, b = key[order], more[order]
        place = np.zeros(len(key), np.int64)
        place[order] = np.cumsum(np.r_[False, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return _answers(table, place, _read(table["counts"], np.uint32).astype(np.int64), n, least)

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            shard = Shard(row, n)
            shard.number_words(row["words"])
            _, bucket, key, counts = shard.pairs()
            held = list(runs(bucket))
            yield _sent(row, np.array([b for b, _, _ in held], np.int64), [(j - i, packed(key[i:j]), b"", packed(counts[i:j].astype(np.uint32))) for _, i, j in held])

    def send_longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            shard = Shard(row, n)
            shard.number_words(row["words"])
            shard.number_pairs(row["pairs"])
            _, _, bucket, key, more, counts = shard.longer()
            held = list(runs(bucket))
            yield _sent(row, np.array([b for b, _, _ in held], np.int64), [(j - i, packed(key[i:j]), packed(more[i:j]), packed(counts[i:j].astype(np.uint32))) for _, i, j in held])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            shard = Shard(row, n)
            shard.number_words(row["words"])
            shard.number_pairs(row["pairs"])
            texts, sizes, counts = shard.spelled(row["longer"])
            for i in range(0, len(texts), 8192):
                part = slice(i, i + 8192)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([row["lang"]] * len(texts[part]), pa.string()), "phrase": pa.array(texts[part], pa.binary()).cast(pa.string()), "k": pa.array(sizes[part], pa.int32()), "f": pa.array(counts[part], pa.int64())})

    def asked(sender, number, known: DataFrame, name: str) -> DataFrame:
        answers = space.save(known.mapInArrow(sender, _SENT).groupBy("bucket").applyInArrow(number, _ANSWER), name)
        return known.join(answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "numbers", "counts")).alias(name)), "chunk", "left")

    worded = asked(send_words, number_words, shards, "words")
    paired = asked(send_pairs, number_keys, worded, "pairs")
    whole = asked(send_longer, number_keys, paired, "longer")
    out = space.save(whole.mapInArrow(spell, "lang string, phrase string, k int, f long"), "phrases")
    return out, shards.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, space: Workspace, least: int = LEAST, top: int = TOP, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer one subsumes."""
    known, totals = frequent_phrases(docs, space, least, chunk_text)
    phrases = known.where("k > 1").withColumn("w", F.split("phrase", " "))
    links = phrases.where("k > 2").select("lang", "f", F.explode(F.array(F.expr("slice(w, 2, k - 1)"), F.expr("slice(w, 1, k - 1)"))).alias("part"))
    around = links.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("f").alias("longer"))
    free = phrases.join(around, ["lang", "phrase"], "left").where("longer IS NULL OR longer < f")
    cut = free.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select("lang", "phrase", "a", "cut", F.array_join(F.expr("slice(w, 1, cut)"), " ").alias("head"), F.array_join(F.expr("slice(w, cut + 1, 5)"), " ").alias("rest"))
    counted = cut.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    counted = counted.select("lang", "phrase", "a", "n", "cut", "l", "r", exact("a").alias("da"), exact("n").alias("dn"), exact("l").alias("dl"), exact("r").alias("dr"))
    scored = counted.withColumn("score", F.expr("(1000 * da * dn) div (dl * dr)"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM placed, (SELECT unnest(range(1, {DEPTH + 1})) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
links AS (SELECT lang, f, unnest([array_to_string(w[2:], ' '), array_to_string(w[:k - 1], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 2)),
free AS (SELECT * FROM grams g WHERE k > 1 AND NOT EXISTS (FROM links x WHERE x.lang = g.lang AND x.phrase = g.phrase AND x.f >= g.f)),
cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM free),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, n, c.c, (1000 * a::HUGEINT * n) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN totals USING (lang)
  JOIN grams h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[:c.c], ' ') JOIN grams t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.c + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= {TOP}
"""
