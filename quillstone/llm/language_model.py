"""Language-model scoring: a log-frequency Bloom filter of quantised n-gram counts, probed for smoothed probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from quillstone.llm import _text
from quillstone.llm._store import column, small_batches, written
from quillstone.llm.toxicity import remainder_is

#: Bytes of filter and unigram table that are broadcast, of which each Python worker holds a copy and the driver two; a
#: larger model is taken to the texts by a join, in chunks.
BROADCAST_BYTES = 256 << 20
#: Bytes of text whose n-grams are counted in one group, and of a chunk of texts that is scored by a join.
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 16 << 20
#: Tokens whose n-grams a task counts at a time, at about 80 bytes each.
COUNTED_TOKENS = 2_000_000
BITS_PER_ENTRY, PROBES = 16, 11
#: Weight of the unigram model against bigrams: a context of c occurrences trusts them by c / (c + TRUST).
TRUST = 8.0
#: Counts of level l lie in [2^(l-1), 2^l).
LEVELS = 40
#: What a pair of each level counts as, in tenths: whole numbers, so that a context's sum is the same in any order.
PAIR_TENTHS = np.array([0, 10, *(26 << i for i in range(LEVELS - 2))], np.int64)
_END = np.uint64(0x6A09E667F3BCC909)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words (A-Z lower-cased) and one end token, and each text's place in them."""
    starts, ends, at = _text.words(data, offsets)
    n = np.diff(at)
    places = at + np.arange(len(at))
    out = np.full(int(places[-1]), _END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = _text.word_hashes(data, starts, ends)
    return out, places


def bigrams(tokens: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token, its hash together with the one before it (the end token, at a text's start), and that one."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[places[:-1][places[:-1] < len(tokens)]] = _END
    return _text.mix64(before * _PAIR + tokens), before


def level(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


class Bloom:
    """Blocks of bits; a key's top bits choose its block, so that each block can be built and held on its own.

    A key of level l is entered l times, once with each level up to its own; probing levels in turn until one is
    missing reads the level back. A false positive can only raise it, by one level with a small probability.
    """

    def __init__(self, bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.bits, self.starts, self.sizes = bits, starts, sizes
        self.shift = np.uint64(64 - int(math.log2(len(sizes))))

    @classmethod
    def block(cls, keys: np.ndarray, counts: np.ndarray) -> bytes:
        levels = level(counts)
        size = np.uint64(8 * max(8, -(-int(levels.sum()) * BITS_PER_ENTRY // 8)))
        bits = np.zeros(int(size), bool)
        for at in range(1, int(levels.max(initial=0)) + 1):
            a, b = _pair(keys[levels >= at], at)
            for i in range(PROBES):
                bits[(a + np.uint64(i) * b) % size] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        block = (keys >> self.shift).astype(np.int64) if len(self.sizes) > 1 else np.zeros(len(keys), np.int64)
        for at in range(1, LEVELS):
            if not len(left):
                break
            a, b = _pair(keys[left], at)
            size, start = self.sizes[block[left]], self.starts[block[left]]
            for i in range(PROBES):
                place = (a + np.uint64(i) * b) % size + start
                there = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                left, a, b, size, start = left[there], a[there], b[there], size[there], start[there]
            out[left] = at
        return out


def _pair(keys: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of a key's probes at a level."""
    a = _text.mix64(keys + np.uint64(at * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return a, _text.mix64(a ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


@dataclass
class Statistics:
    """Totals of the training texts, exact whatever the filter's false positives."""

    tokens: int
    types: int
    singles: int
    doubles: int
    pair_singles: int
    pair_doubles: int
    means: np.ndarray
    #: How often the filter of pairs says yes to a key that was never entered.
    false_rate: float = 0.0

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of additively smoothed unigram probabilities."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def log10(self, word: np.ndarray, types: np.ndarray, tenths: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """log10 probabilities from a word's level, its context's distinct continuations and their sum, and the pair's level.

        Unigrams are discounted absolutely, and what is taken off is the unknown word's; a level stands for the mean
        count of its keys. Pairs are discounted likewise: what each of a context's continuations gives up goes to the
        unigrams. A context's pairs are divided by the sum of what their levels stand for, so that the probabilities
        of all words and the unknown one sum to 1 after every context, but for the filter's false positives. How many
        known words these are likely to hit after a context follows from the filter's fill, and what they would add is
        divided out.
        """
        if not self.tokens:
            return np.full(len(word), math.log10(0.5))
        off = self.singles / max(1, self.singles + 2 * self.doubles)
        off = min(max(off, 0.05), 0.95)
        one = np.where(word > 0, (self.means[word] - off) / self.tokens, off * self.types / self.tokens)
        pair_off = min(max(self.pair_singles / max(1, self.pair_singles + 2 * self.pair_doubles), 0.05), 0.9)
        seen = tenths / 10
        two = np.where((pair > 0) & (tenths > 0), (np.minimum(PAIR_TENTHS[pair], tenths) / 10 - pair_off) / (seen + TRUST), 0.0)
        rest = (TRUST + pair_off * types) / (seen + TRUST)
        added = sum(self.false_rate**at * ((PAIR_TENTHS[at] - PAIR_TENTHS[at - 1]) / 10 - (pair_off if at == 1 else 0)) for at in (1, 2, 3))
        false = np.where(tenths > 0, (self.types - types) * added / (seen + TRUST), 0.0)
        return np.log10((two + rest * one) / (1 + false))


class Held:
    """The model in memory: both filters, and the unigram table as sorted hashes and their facts.

    A word's facts are its count, its distinct continuations, and the sum of their pairs' levels in tenths.
    """

    def __init__(self, keys: np.ndarray, facts: tuple[np.ndarray, np.ndarray, np.ndarray], one: Bloom, two: Bloom):
        self.keys, self.values, self.one, self.two = keys, facts, one, two

    def facts(self, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(self.keys):
            return tuple(np.zeros(len(tokens), np.int64) for _ in self.values)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return tuple(np.where(self.keys[at] == tokens, v[at], 0) for v in self.values)

    def word_levels(self, tokens: np.ndarray) -> np.ndarray:
        return self.one.levels(tokens)

    def pair_levels(self, pairs: np.ndarray) -> np.ndarray:
        return self.two.levels(pairs)


class Looked(Held):
    """What the blocks answered about the n-grams of one chunk, as sorted tables."""

    def __init__(self, answers: dict[int, tuple[np.ndarray, ...]]):
        self.tables = answers

    def _of(self, kind: int, keys: np.ndarray, field: int) -> np.ndarray:
        table = self.tables[kind]
        return table[field][np.searchsorted(table[0], keys)]

    def facts(self, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(self._of(1, tokens, i) for i in (2, 3, 4))

    def word_levels(self, tokens: np.ndarray) -> np.ndarray:
        return self._of(1, tokens, 1)

    def pair_levels(self, pairs: np.ndarray) -> np.ndarray:
        return self._of(2, pairs, 1)


def _scores(column: pa.Array, model: Held, known: Statistics) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    out = [np.empty(len(column), np.int64), np.empty(len(column), np.int64), np.empty(len(column)), np.empty(len(column))]
    for begin, end, data, offsets in _text.text_chunks(column):
        tokens, places = token_hashes(data, offsets)
        pairs, before = bigrams(tokens, places)
        distinct, which = np.unique(np.append(tokens, _END), return_inverse=True)
        counts, types, tenths = model.facts(distinct)
        counts, context = counts[which[:-1]], np.searchsorted(distinct, before)
        values = known.log10(model.word_levels(distinct)[which[:-1]], types[context], tenths[context], model.pair_levels(pairs))
        at = places[:-1]
        out[0][begin:end] = np.diff(places)
        out[1][begin:end] = np.add.reduceat((counts > 0).astype(np.int64), at)
        out[2][begin:end] = np.add.reduceat(known.base(counts), at)
        out[3][begin:end] = np.add.reduceat(values, at)
    return out


def _blocks(keys: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sorted keys and their counts by block, a block being a key's top bits."""
    at = np.searchsorted(keys, np.arange(blocks, dtype=np.uint64) << np.uint64(64 - int(math.log2(blocks)))) if blocks > 1 else np.zeros(1, np.int64)
    for i, (a, b) in enumerate(zip(at, [*at[1:], len(keys)], strict=True)):
        if b > a:
            yield i, keys[a:b], counts[a:b]


_COUNTED = "kind int, block int, keys binary, counts binary, contexts binary"
_MODEL = "kind int, block int, n bigint, n1 bigint, n2 bigint, total bigint, ones bigint, level_n array<bigint>, level_sum array<bigint>, keys binary, counts binary, types binary, tenths binary, bits binary"
_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2, *[pa.binary()] * 5]
_NAMES = [c.split()[0] for c in _MODEL.split(", ")]


def _model_table(rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(c) for r in rows], k) for c, k in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def train(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The model's blocks, a written table: for either kind (1 words, 2 pairs) filter bits, totals, and words' facts.

    A task counts the n-grams of a few million tokens at a time and sends each block's sorted keys and counts as one
    row, so a frequent word or a text copied many times makes one entry of each task; a block then adds up what the
    tasks sent. A block of pairs sends each block of words how many continuations it holds of their contexts, and what
    these count as; the blocks of words add that up. Blocks grow in number with the texts and not in size. Null and
    empty texts have only their end token.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = 1 << max(0, math.ceil(math.log2(max(1, size / BLOCK_BYTES))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def row(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray) -> pa.RecordBatch:
            values = [[kind], [block], [keys.tobytes()], [counts.tobytes()], [contexts.tobytes()]]
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["kind", "block", "keys", "counts", "contexts"])

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            tokens = np.concatenate(held)
            held.clear()
            keys, counts = np.unique(tokens, return_counts=True)
            for block, k, c in _blocks(keys, counts.astype(np.int32), blocks):
                yield row(1, block, k, c, np.empty(0, np.uint64))
            # Each text ends with the end token, which so is also before the next one's first word.
            pairs, before = bigrams(tokens, np.array([0, len(tokens)]))
            order = np.argsort(pairs)
            pairs = pairs[order]
            at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            contexts, counts = before[order[at]], np.diff(np.append(at, len(pairs))).astype(np.int32)
            for block, k, i in _blocks(pairs[at], np.arange(len(at)), blocks):
                yield row(2, block, k, counts[i], contexts[i])

        for batch in batches:
            for _, _, data, offsets in _text.text_chunks(batch.column(0)):
                tokens, _ = token_hashes(data, offsets)
                held.append(tokens)
                n += len(tokens)
                if n > COUNTED_TOKENS:
                    yield from out()
                    n = 0
        yield from out()

    def add_up(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        keys = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in table["keys"]])
        counts = np.concatenate([np.frombuffer(c.as_buffer(), np.int32) for c in table["counts"]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, counts = keys[at], np.add.reduceat(counts[order].astype(np.int64), at)
        levels = level(counts)
        level_n, level_sum = np.bincount(levels, minlength=LEVELS), np.bincount(levels, counts, minlength=LEVELS)
        row = {"kind": kind, "block": table["block"][0].as_py(), "n": len(keys), "n1": int((counts == 1).sum()), "n2": int((counts == 2).sum()), "total": int(counts.sum()), "level_n": level_n, "level_sum": level_sum.astype(np.int64)}
        row |= {"keys": keys.tobytes() if kind == 1 else b"", "counts": counts.tobytes() if kind == 1 else b"", "bits": (bits := Bloom.block(keys, counts)), "ones": int(np.bitwise_count(np.frombuffer(bits, np.uint8)).sum())}
        if kind == 1:
            return _model_table([row])
        contexts = np.concatenate([np.frombuffer(c.as_buffer(), np.uint64) for c in table["contexts"]])[order[at]]
        order = np.argsort(contexts, kind="stable")
        contexts = contexts[order]
        at = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
        types, tenths = np.diff(np.append(at, len(contexts))), np.add.reduceat(PAIR_TENTHS[levels[order]], at)
        parts = [{"kind": 1, "block": block, "keys": k.tobytes(), "types": types[i].tobytes(), "tenths": tenths[i].tobytes()} for block, k, i in _blocks(contexts[at], np.arange(len(at)), blocks)]
        return _model_table([row, *parts])

    def join_up(table: pa.Table) -> pa.Table:
        own = table.filter(pa.compute.is_valid(table["bits"]))
        if table["kind"][0].as_py() == 2:
            return own
        row = own.to_pylist()[0]
        words, parts = np.frombuffer(row["keys"], np.uint64), table.filter(pa.compute.is_null(table["bits"]))
        facts = {c: np.zeros(len(words), np.int64) for c in ("types", "tenths")}
        for keys, *values in zip(*(parts[c] for c in ("keys", *facts)), strict=True):
            at = np.searchsorted(words, np.frombuffer(keys.as_buffer(), np.uint64))
            for total, v in zip(facts.values(), values, strict=True):
                total[at] += np.frombuffer(v.as_buffer(), np.int64)
        return _model_table([row | {c: v.tobytes() for c, v in facts.items()}])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, _COUNTED)
    added = counted.groupBy("kind", "block").applyInArrow(add_up, _MODEL)
    return written(added.groupBy("kind", "block").applyInArrow(join_up, _MODEL), "language-model").withColumn("blocks", F.lit(blocks))


def statistics(model: DataFrame) -> Statistics:
    """The model's totals; all zero for a model of no texts."""
    each = {r["kind"]: r for r in model.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("total", "n", "n1", "n2"))).collect()}
    levels = model.where("kind = 1").select(F.posexplode(F.arrays_zip("level_n", "level_sum")).alias("level", "of")).groupBy("level").agg(F.sum("of.level_n").alias("n"), F.sum("of.level_sum").alias("sum"))
    means = np.array([0.0, *(2.0**i for i in range(1, LEVELS))])
    for r in levels.where("level > 0 AND n > 0").collect():
        means[r["level"]] = r["sum"] / r["n"]
    fill = model.where("kind = 2").agg(F.sum("ones") / F.sum(8 * F.octet_length("bits"))).first()[0] or 0.0
    words, pairs = ([each[kind][c] for c in ("total", "n", "n1", "n2")] if kind in each else [0] * 4 for kind in (1, 2))
    return Statistics(*words, *pairs[2:], means, float(fill) ** PROBES)


def _one_block(bits: bytes) -> Bloom:
    return Bloom(np.frombuffer(bits, np.uint8), np.zeros(1, np.uint64), np.array([8 * len(bits)], np.uint64))


def held_model(model: DataFrame, blocks: int) -> Held:
    """The whole model in memory. Blocks are fetched one partition at a time into arrays of their final size."""
    sizes = model.select("kind", "block", "n", F.octet_length("bits").alias("bits")).collect()
    starts, widths = np.zeros((2, blocks), np.uint64), np.full((2, blocks), 64, np.uint64)
    at, first, n = [8, 8], {}, 0  # a block without a key points at eight empty bytes before all others
    for r in sorted(sizes, key=lambda r: (r["kind"], r["block"])):
        k = r["kind"] - 1
        starts[k, r["block"]], widths[k, r["block"]] = 8 * at[k], 8 * r["bits"]
        at[k] += r["bits"]
        if k == 0:
            first[r["block"]], n = n, n + r["n"]
    bits = [np.zeros(size, np.uint8) for size in at]
    keys, facts = np.empty(n, np.uint64), tuple(np.empty(n, np.int64) for _ in _FACTS)
    for r in model.select("kind", "block", "keys", *_FACTS, "bits").toLocalIterator():
        k, begin = r["kind"] - 1, int(starts[r["kind"] - 1, r["block"]]) // 8
        bits[k][begin : begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        if k == 0:
            own, at_key = np.frombuffer(r["keys"], np.uint64), first[r["block"]]
            keys[at_key : at_key + len(own)] = own
            for c, values in zip(_FACTS, facts, strict=True):
                values[at_key : at_key + len(own)] = np.frombuffer(r[c], np.int64)
    facts = tuple(v.astype(np.int32) if v.max(initial=0) < 1 << 31 else v for v in facts)
    return Held(keys, facts, *(Bloom(bits[k], starts[k], widths[k]) for k in (0, 1)))


_FACTS = ("counts", "types", "tenths")
_OUT = ("n_tokens", "n_known", "base_score", "score")


def scored(docs: DataFrame, model: DataFrame, *, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, carried: Sequence[str] | None = None) -> DataFrame:
    """The rows with ``n_tokens, n_known, train_tokens, base_score, score`` added (columns of these names are replaced).

    Only the ``carried`` columns come back from the workers, by default all; a text that is not wanted need not. Null and empty texts have one token, their end. The model is broadcast if it has at most ``broadcast_bytes``; a
    larger one stays where it is: chunks of texts send each block the n-grams they have, and get its answers back. Both
    ways give the same scores.
    """
    small_batches(docs.sparkSession)
    known = statistics(model)
    kept = [c for c in docs.columns if c not in (*_OUT, "train_tokens")]
    docs = docs.select(*(column(c) for c in kept))
    at = kept.index(text_col)
    back = [i for i, c in enumerate(kept) if carried is None or c in carried]
    schema = StructType([docs.schema.fields[i] for i in back])
    for name, kind in zip(_OUT, (LongType(), LongType(), DoubleType(), DoubleType()), strict=True):
        schema = schema.add(name, kind)
    size = model.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("keys", *_FACTS, "bits")), F.lit(0))), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _scored_in_chunks(docs, model, known, at, back, schema).withColumn("train_tokens", F.lit(known.tokens).cast("bigint"))
    blocks = model.select(F.max("blocks")).first()[0] or 1
    held = docs.sparkSession.sparkContext.broadcast((held_model(model, blocks), known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in back), *map(pa.array, _scores(batch.column(at), *held.value))], names=[*(kept[i] for i in back), *_OUT])

    return docs.mapInArrow(score, schema).withColumn("train_tokens", F.lit(known.tokens).cast("bigint"))


def _scored_in_chunks(docs: DataFrame, model: DataFrame, known: Statistics, at: int, back: list[int], schema: StructType) -> DataFrame:
    names = docs.columns
    text = column(names[at])
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    blocks = model.select(F.max("blocks")).first()[0] or 1
    row = F.struct(*(column(c) for c in names))
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, -(-size // CHUNK_BYTES)))).cast("bigint")
    dealt = written(docs.select(chunk.alias("chunk"), row.alias("row")), "scoring")
    texts = dealt.select("chunk", F.col("row").getField(names[at]).alias("text"))

    def ask(table: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.array([_END])], []]
        for column in table["text"].chunks:
            for _, _, data, offsets in _text.text_chunks(column):
                tokens, places = token_hashes(data, offsets)
                found[0].append(np.unique(tokens))
                found[1].append(np.unique(bigrams(tokens, places)[0]))
        out = []
        for kind in (1, 2):
            keys = np.unique(np.concatenate(found[kind - 1])) if found[kind - 1] else np.empty(0, np.uint64)
            out += [(table["chunk"][0].as_py(), kind, block, k.tobytes()) for block, k, _ in _blocks(keys, keys, blocks)]
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["chunk", "kind", "block", "keys"])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        for chunk, kind, block, keys in zip(*(asked[c] for c in ("chunk", "kind", "block", "keys")), strict=True):
            keys = np.frombuffer(keys.as_buffer(), np.uint64)
            levels, facts = np.zeros(len(keys), np.int64), tuple(np.zeros(len(keys) if kind.as_py() == 1 else 0, np.int64) for _ in _FACTS)
            if len(own):
                one = _one_block(own["bits"][0].as_py())
                levels = one.levels(keys)
                if kind.as_py() == 1:
                    facts = Held(np.frombuffer(own["keys"][0].as_py(), np.uint64), tuple(np.frombuffer(own[c][0].as_py(), np.int64) for c in _FACTS), one, one).facts(keys)
            out.append((chunk.as_py(), kind.as_py(), keys.tobytes(), levels.tobytes(), *(v.tobytes() for v in facts)))
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int32(), *[pa.binary()] * 5))], names=["chunk", "kind", "keys", "levels", *_FACTS])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tables = {}
        for kind in (1, 2):
            own = answers.filter(pa.compute.equal(answers["kind"], kind))
            parts = [np.frombuffer(b"".join(v.as_py() for v in own[c]), np.uint64 if c == "keys" else np.int64) for c in ("keys", "levels", *(_FACTS if kind == 1 else ()))]
            order = np.argsort(parts[0])
            tables[kind] = tuple(p[order] for p in parts)
        whole = pa.Table.from_struct_array(rows["row"])
        values = _scores(whole.column(at).combine_chunks(), Looked(tables), known)
        whole = whole.select([names[i] for i in back])
        for name, v in zip(_OUT, values, strict=True):
            whole = whole.append_column(name, pa.array(v))
        return whole

    asked = texts.groupBy("chunk").applyInArrow(ask, "chunk bigint, kind int, block int, keys binary")
    answers = asked.groupBy("kind", "block").cogroup(model.select("kind", "block", "keys", *_FACTS, "bits").groupBy("kind", "block")).applyInArrow(answer, "chunk bigint, kind int, keys binary, levels binary, counts binary, types binary, tenths binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under the training documents' model, and its additive unigram score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~remainder_is(F.col("doc_id"), 5, 1)))
    return scored(docs, model, carried=["doc_id"]).select("doc_id", remainder_is(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_language_model": op3_language_model}
ORACLES: dict[str, str] = {}
