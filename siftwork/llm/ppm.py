"""LM scoring by prediction by partial matching (PPM) over bytes.

A text is lower-cased (A-Z), cut into words, and spelt as its words with a space between two and one end byte. A trie
of byte contexts of up to ORDER bytes, learnt from the training documents, predicts each byte: in the longest context
that the trie holds, a byte seen there c times has the chance (2c-1)/2T (T: bytes seen there, D: distinct ones), and
D/2T is left for an escape to the next shorter context. There the bytes of the longer context are excluded: T and D
are taken without them. After the empty context all 256 bytes not yet excluded are equally likely. A document's score
is the log10 of the product over all its bytes, end byte included.

As every context of a trie holds the bytes of its longer ones, what an escape excludes is just the longer context's
own bytes; the exclusion is so a number of the trie's nodes (`taken`: what their bytes count in the next shorter
context), computed once, and scoring needs no sets.

Learning counts (ORDER+1)-byte grams, of which the shorter contexts' counts are sums, in one pass and one shuffle. The
trie is cut into shards of about SHARD grams by the last two context bytes, and by the third where two bytes have more;
the two-byte grams (at most 65,536), and the three-byte grams of contexts that were cut, are in each. Word counts for
the base score are sharded by the word's 64-bit hash.

The shards stay in a table. The chances of the HOT most frequent grams, and the counts of as many words, are sent to all
workers, whatever the corpus has. To score, texts are taken in runs of about RUN bytes; what those tables do not hold
is asked of the shards: the distinct other grams and words of each run go there, are looked up, and their values come
back to the run's texts, which wait as numbers of their questions. Neither the model nor a share of it that grows with
the corpus is sent to the driver or to all workers.
"""

from __future__ import annotations

import contextlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch, table, text_batches, worker_memory

ORDER = 5
#: Grams or words a shard, about.
SHARD = 150_000
#: Bytes of text that are scored or counted at a time; distinct keys after which a task hands on its counts; keys a row
#: that travels; such rows that a task takes at a time.
RUN, KEYS, PIECE, ROWS = 3 << 19, 1_000_000, 1 << 14, 16
#: Rows of keys a shard, on average, above which its table is given out several times.
ASKED = 4096
#: Grams, and words, whose values all workers have, at most.
HOT = 1 << 18
END = b"\n"
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
GRAM, WORD = 0, 1


def _least(values: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))) if values.dtype.kind in "iu" else values


class Lookup:
    """Values by 64-bit keys: keys mixed by an odd factor (which maps them one to one), sorted, with an index on their high bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        mixed = keys.astype(_U) * _MIX
        order = np.argsort(mixed)
        self.bits = max(1, int(len(keys)).bit_length())
        self.mixed = np.append(mixed[order], _U(2**64 - 1))
        self.values = [np.append(v[order], v.dtype.type(0)) for v in map(_least, values)]
        self.index = np.searchsorted(self.mixed[:-1], np.arange(1 << self.bits, dtype=_U) << _U(64 - self.bits)).astype(np.int32)
        self.n = len(keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, and which keys there are."""
        mixed = keys * _MIX
        at = self.index[(mixed >> _U(64 - self.bits)).astype(np.int64)]
        there = self.mixed[at]
        behind = np.flatnonzero(there < mixed)
        while len(behind):
            at[behind] += 1
            now = self.mixed[at[behind]]
            there[behind] = now
            behind = behind[now < mixed[behind]]
        return at, (there == mixed) & (at < self.n)


def spell(text: str | None) -> tuple[bytes, list[bytes]]:
    """The bytes that are scored, and the words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return b" ".join(words) + END, words


def grams(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the spelt texts one after the other, END standing before each text; and where each text's grams start."""
    data = np.frombuffer(b"".join(END * ORDER + s for s in spelt), np.uint8).astype(_U)
    g = np.zeros(len(data) - ORDER, _U)
    for k in range(ORDER + 1):
        g |= data[ORDER - k : len(data) - k] << _U(8 * k)
    sizes = np.array([len(s) for s in spelt])
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    return g, starts


def _own(g: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The grams without those that reach from one text into the next."""
    keep = np.zeros(len(g) + 1, np.int8)
    keep[starts] += 1
    keep[starts + sizes] -= 1
    return g[np.cumsum(keep[:-1]).astype(bool)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _clear() -> None:
    _hashes.clear()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), _U, len(words))


def _runs(batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about `size` bytes of text, or one text."""
    for batch in batches:
        column = batch.column(at)
        sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in column)])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + size)))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (kind, key, n), summed within the task as far as KEYS allows."""
    worker_memory("ppm", _clear)
    held: dict[int, list] = {GRAM: [], WORD: []}

    def hand_on(kind: int) -> Iterator[pa.RecordBatch]:
        if held[kind]:
            k, n = _summed(*map(list, zip(*held[kind], strict=True)))
            held[kind] = []
            for lo in range(0, len(k), 200_000):
                part = k[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[lo : lo + 200_000])], ["kind", "key", "n"])

    for run in _runs(batches, 0, 1 << 20):
        spelt, words = zip(*map(spell, run.column(0).to_pylist()), strict=True)
        g, starts = grams(list(spelt))
        own = _own(g, starts, np.array([len(s) for s in spelt]))
        for kind, keys in ((GRAM, own), (WORD, np.concatenate([_word_hashes(w) for w in words]))):
            held[kind].append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held[kind]) > KEYS:
                held[kind] = [_summed(*map(list, zip(*held[kind], strict=True)))]
                if len(held[kind][0][0]) > KEYS:
                    yield from hand_on(kind)
    yield from hand_on(GRAM)
    yield from hand_on(WORD)


def _totals(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    return _summed([key[order]], [n[order]])


class Trie:
    """Tables of one shard: log10 chances of the longest grams, and entries and nodes of all orders for escapes."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray], middle: tuple[np.ndarray, np.ndarray] | None = None):
        """keys, n: the shard's (ORDER+1)-byte grams; short: all two-byte grams of the corpus; middle: the three-byte grams of
        the shard's contexts, where other shards hold a part of them."""
        levels = {ORDER: _totals(keys, n)}
        for j in range(ORDER - 1, 1, -1):
            k, c = levels[j + 1]
            levels[j] = _totals(k & _U((1 << 8 * (j + 1)) - 1), c)
        if middle:
            levels[2] = _totals(*middle)
        levels[1] = _totals(*short)
        levels[0] = _totals(levels[1][0] & _U(0xFF), levels[1][1])
        self.entries, self.nodes = {}, {}
        for j in range(ORDER + 1):
            k, c = levels[j]
            first = np.flatnonzero(np.append(True, (k >> _U(8))[1:] != (k >> _U(8))[:-1])) if len(k) else np.zeros(0, int)
            contexts = (k >> _U(8))[first]
            total = np.add.reduceat(c, first) if len(k) else c
            distinct = np.diff(np.append(first, len(k)))
            if j:  # what the bytes of each context count in the next shorter one
                at, found = self.entries[j - 1].find(k & _U((1 << 8 * j) - 1))
                assert found.all()
                taken = np.add.reduceat(self.entries[j - 1].values[0][at].astype(np.int64), first) if len(k) else c
            else:
                taken = np.zeros(len(first), np.int64)
            self.nodes[j] = Lookup(contexts, total, distinct, taken)
            if j < ORDER:
                self.entries[j] = Lookup(k, c)
            else:
                chance = np.log10((2 * c - 1) / np.repeat(2 * total, distinct))
                self.direct = Lookup(k, chance)

    def log10(self, g: np.ndarray) -> np.ndarray:
        at, found = self.direct.find(g)
        out = self.direct.values[0][at]
        rest = np.flatnonzero(~found)
        if len(rest):
            out[rest] = self._escapes(g[rest])
        return out

    def _escapes(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g))
        todo = np.arange(len(g))
        minus_t, minus_d = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for j in range(ORDER, -1, -1):
            key = g[todo] & _U((1 << 8 * (j + 1)) - 1)
            node, known = self.nodes[j].find(key >> _U(8))
            total, distinct, taken = (v[node].astype(np.int64) for v in self.nodes[j].values)
            t, d = total - minus_t[todo], distinct - minus_d[todo]
            if j < ORDER:
                at, hit = self.entries[j].find(key)
                hit &= known
                out[todo[hit]] += np.log10((2.0 * self.entries[j].values[0][at[hit]] - 1) / (2 * t[hit]))
            else:  # only grams that the longest contexts do not hold come here
                hit = np.zeros(len(todo), bool)
            escape = known & ~hit
            some = escape & (d > 0)
            out[todo[some]] += np.log10(d[some] / (2 * t[some]))
            minus_t[todo[escape]], minus_d[todo[escape]] = taken[escape], distinct[escape]
            todo = todo[~hit]
        out[todo] -= np.log10(256 - minus_d[todo])
        return out


class Model:
    """Shards of a trie and of word counts in a table, with the corpus totals."""

    def __init__(self, tables: DataFrame, shard_of: np.ndarray, parts: np.ndarray, tries: int, words: int, short: tuple, middle: tuple | None, hot: tuple, n: int, v: int, ends: int):
        """tables: (shard, keys, counts), shards of words after the tries' ones; shard_of, parts: first shard and number of shards
        of grams by two context bytes; short, middle: all two-byte grams, and the three-byte ones of contexts in several shards; hot: keys and values of
        frequent grams, and of frequent words; n, v: tokens and distinct tokens, end tokens included; ends: documents."""
        self.tables, self.shard_of, self.parts, self.tries, self.words, self.short, self.middle, self.hot, self.n, self.v, self.ends = tables, shard_of, parts, tries, words, short, middle, hot, n, v, ends


def deal_contexts(contexts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shard and the number of shards of each two context bytes, and the number of all shards: contexts of more
    than SHARD grams are cut in up to 256 by the third byte, others share shards."""
    shard_of, parts = np.zeros(1 << 16, np.int32), np.ones(1 << 16, np.int32)
    large = sizes > SHARD
    rest = np.cumsum(sizes[~large])
    shard_of[contexts[~large]] = (rest - sizes[~large]) // SHARD
    shards = int(shard_of.max()) + 1
    parts[contexts[large]] = np.minimum(-(-sizes[large] // SHARD), 256)
    own = parts[contexts[large]]
    shard_of[contexts[large]] = shards + np.cumsum(own) - own
    return shard_of, parts, shards + int(own.sum())


def train(docs: DataFrame) -> Model:
    """Learn from all texts of `docs`; a null text is an empty one."""
    spark = docs.sparkSession
    text_batches(spark)
    counts = materialise(docs.select("text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    totals = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()}
    ends = docs.count()
    n_words = totals[WORD]["keys"] if WORD in totals else 0
    n = (totals[WORD]["n"] if WORD in totals else 0) + ends
    v = n_words + (ends > 0)
    of_grams = counts.where(F.col("kind") == GRAM)
    low = lambda bytes_: F.col("key").bitwiseAND(F.lit((1 << 8 * bytes_) - 1).cast("long"))
    context = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toPandas()
        return got["k"].to_numpy(np.int64).view(_U), got["n"].to_numpy(np.int64)

    # 65,536 rows at most, both
    short = arrays(of_grams.groupBy(low(2).alias("k")).agg(F.sum("n").alias("n")))
    contexts, sizes = arrays(of_grams.groupBy(context.cast("long").alias("k")).agg(F.count("*").alias("n")))
    shard_of, parts, tries = deal_contexts(contexts.astype(np.int64), sizes)
    dealt = F.broadcast(spark.createDataFrame([(int(k), int(shard_of[k]), int(parts[k])) for k in contexts], "context int, base int, parts int"))
    placed = of_grams.withColumn("context", context).join(dealt, "context")
    # three-byte grams of the contexts that were cut: 256 a context at most
    middle = arrays(placed.where("parts > 1").groupBy(low(3).alias("k")).agg(F.sum("n").alias("n"))) if (parts > 1).any() else None

    def pack(group):
        group = group.sort_values("key")
        return group[["shard"]].iloc[:1].assign(keys=[_pack(group["key"].to_numpy(np.int64))], counts=[_pack(group["n"].to_numpy(np.int64))])

    words = max(1, -(-n_words // SHARD))
    third = F.shiftright("key", 24).bitwiseAND(F.lit(0xFF).cast("long"))
    grams_ = placed.select((F.col("base") + F.pmod(third, F.col("parts"))).cast("int").alias("shard"), "key", "n")
    words_ = counts.where(F.col("kind") == WORD).select((F.lit(tries) + F.pmod("key", F.lit(words))).cast("int").alias("shard"), "key", "n")
    tables = grams_.unionByName(words_).groupBy("shard").applyInPandas(pack, "shard int, keys binary, counts binary")
    hot = _frequent(of_grams, F.shiftright("key", 8)), _frequent(counts.where(F.col("kind") == WORD))
    return Model(materialise(tables, "shards"), shard_of, parts, tries, words, short, middle, hot, n, v, ends)


def _frequent(counts: DataFrame, context: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and log10 of 1 + their count or, with a context, of their chance in it, of the HOT keys of greatest counts; of
    those that share the least count all or none."""
    sizes = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("k")).toPandas().sort_values("n", ascending=False)  # 65,536 rows at most
    upto = sizes["n"][sizes["k"].cumsum() <= HOT]
    some = counts.where(F.col("n") >= int(upto.min())) if len(upto) else counts.limit(0)
    if context is None:
        got = some.select("key", "n").toPandas()
        return got["key"].to_numpy(np.int64).view(_U), np.log10(1.0 + got["n"].to_numpy(np.int64))
    whole = counts.groupBy(context.alias("context")).agg(F.sum("n").alias("total"))
    got = some.select("key", "n", context.alias("context")).join(whole, "context").select("key", "n", "total").toPandas()
    n = got["n"].to_numpy(np.int64)
    return got["key"].to_numpy(np.int64).view(_U), np.log10((2 * n - 1) / (2 * got["total"].to_numpy(np.int64)))


@contextlib.contextmanager
def _rows_at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tables written inside reach Python in batches of so many rows: theirs are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _pack(values: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def _sorted_distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _shards_of(grams_: np.ndarray, shard_of: np.ndarray, parts: np.ndarray) -> np.ndarray:
    context = ((grams_ >> _U(8)) & _U(0xFFFF)).astype(np.int64)
    return shard_of[context] + ((grams_ >> _U(24)) & _U(0xFF)).astype(np.int32) % parts[context]


def score(docs: DataFrame, model: Model, keep: dict[str, str]) -> DataFrame:
    """Columns `keep` (name to type) of docs with n_tokens, n_known, train_tokens, base_score and score of the text.

    A null or empty text is the end token alone; a model of no documents gives every byte 1/256. Columns and rows of
    any kind are passed through, repeated rows scored each; a table without rows gives none.
    """
    spark = docs.sparkSession
    spark = docs.sparkSession
    tries, words, n, v, ends = model.tries, model.words, model.n, model.v, model.ends
    sent = spark.sparkContext.broadcast((model.shard_of, model.parts, model.short, model.middle))  # bounded, see train
    hot = spark.sparkContext.broadcast((model.hot, {}))
    names = [*keep]

    def frequent() -> tuple[Lookup, Lookup]:
        found, made = hot.value
        if not made:
            made[0] = tuple(Lookup(*x) for x in found)
        return made[0]

    def questions(table: Lookup, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values that the table has (0 for others), the places of the others, and their keys."""
        at, known = table.find(keys)
        others = np.flatnonzero(~known)
        return np.where(known, table.values[0][at], 0.0), others, keys[others]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts to runs (shard -1) of what is known of them, and the distinct other grams and words of each run, by shard."""
        worker_memory("ppm", _clear)
        shard_of, parts, *_ = sent.value
        number = TaskContext.get().partitionId() << 32
        for part in _runs(batches, len(names), RUN):
            spelt, found = zip(*map(spell, part.column(len(names)).to_pylist()), strict=True)
            g, starts = grams(list(spelt))
            sizes = np.array([len(s) for s in spelt])
            own = _own(g, starts, sizes)
            n_words = np.array([len(w) for w in found])
            hashes = np.concatenate([_word_hashes(w) for w in found])
            sums, counted, asked, rows = [], [], [], []
            keys_of = [], []
            for table, keys, lengths, word in ((frequent()[0], own, sizes, 0), (frequent()[1], hashes, n_words, 1)):
                values, others, wanted = questions(table, keys)
                of = np.repeat(np.arange(len(lengths)), lengths)
                sums.append(np.bincount(of, values, len(lengths)))
                counted.append(np.bincount(of, values > 0, len(lengths)).astype(np.int64))
                distinct, which = np.unique(wanted, return_inverse=True)
                shards = _shards_of(distinct, shard_of, parts) if not word else (tries + distinct.view(np.int64) % words).astype(np.int32)
                order = np.argsort(shards, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                keys_of[0].append(distinct[order]), keys_of[1].append(shards[order])
                asked.append((place[which], np.bincount(of[others], minlength=len(lengths))))
            n_grams = len(keys_of[0][0])
            keys, shards = np.concatenate(keys_of[0]), np.concatenate(keys_of[1])
            edges = np.flatnonzero(np.append(shards[1:] != shards[:-1], True)) + 1 if len(shards) else shards
            for a, b in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=False):
                rows += [(number, int(shards[a]), lo, _pack(keys[lo : min(b, lo + PIECE)]), None) for lo in range(a, b, PIECE)]
            known = [part.column(i) for i in range(len(names))] + [pa.array(x) for x in (n_words, sums[0], sums[1], counted[1], asked[0][1], asked[1][1])]
            known = pa.RecordBatch.from_arrays(known, [f"c{i}" for i in range(len(known))])
            waiting = pickle.dumps((_ipc(known), n_grams, _pack(asked[0][0]), _pack(asked[1][0] + n_grams)), protocol=5)
            yield _batch([(number, -1, 0, None, waiting), *rows], {"run": pa.int64(), "shard": pa.int32(), "first": pa.int64(), "keys": pa.binary(), "texts": pa.binary()})
            number += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, salt, run, first, keys, counts), ordered by (shard, salt, run), the shard's table first, to (run, first, found)."""
        worker_memory("ppm", _clear)
        shard_of, parts, short, middle = sent.value

        def table(shard: int, keys: np.ndarray, counts: np.ndarray):
            if shard >= tries:
                return Lookup(keys, counts)
            own = None
            if len(keys) and parts[(int(keys[0]) >> 8) & 0xFFFF] > 1:
                some = (middle[0] >> _U(8)) == ((keys[0] >> _U(8)) & _U(0xFFFF))
                own = middle[0][some], middle[1][some]
            return Trie(keys, counts, short, own)

        at, held = None, None
        for batch in batches:
            out = []
            for shard, salt, run, first, keys, counts in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if (shard, salt) != at:
                    at = shard, salt
                    held = table(shard, *((_unpack(keys, _U), _unpack(counts, np.int64)) if counts else (np.zeros(0, _U), np.zeros(0, np.int64))))
                if counts is None:
                    asked = _unpack(keys, _U)
                    if shard < tries:
                        values = held.log10(asked)
                    else:
                        where, hit = held.find(asked)
                        values = np.log10(1.0 + held.values[0][where] * hit)
                    out.append((run, first, _pack(values)))
            if out:
                yield _batch(out, {"run": pa.int64(), "first": pa.int64(), "found": pa.binary()})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (run, first, found, texts), ordered by (run, texts IS NOT NULL, first), to the scores of the run's texts."""
        worker_memory("ppm", _clear)
        held: list[np.ndarray] = []
        for batch in batches:
            for found, texts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if texts is None:
                    held.append(_unpack(found, np.float64))
                else:
                    yield scores(texts, np.concatenate(held) if held else np.zeros(0))
                    held = []

    def scores(texts: bytes, values: np.ndarray) -> pa.RecordBatch:
        known, n_grams, of_grams, of_words = pickle.loads(texts)
        part = pa.ipc.open_stream(known).read_next_batch()
        n_words, total, logs, n_known, asked_grams, asked_words = (part.column(len(names) + i).to_numpy() for i in range(6))
        docs_ = np.arange(part.num_rows)
        total = total + np.bincount(np.repeat(docs_, asked_grams), values[_unpack(of_grams, np.int64)], part.num_rows)
        more = values[_unpack(of_words, np.int64)]
        logs = logs + np.bincount(np.repeat(docs_, asked_words), more, part.num_rows)
        n_known = n_known + np.bincount(np.repeat(docs_, asked_words), more > 0, part.num_rows).astype(np.int64) + (ends > 0)
        base = logs + np.log10(1.0 + ends) - (n_words + 1) * np.log10(n + v + 1.0)
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(n_words + 1), pa.array(n_known), pa.array(np.full(part.num_rows, n)), pa.array(base), pa.array(total)], [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = lambda name: F.lit(None).cast("binary").alias(name)
    asked = materialise(docs.select(*names, "text").mapInArrow(ask, "run long, shard int, first long, keys binary, texts binary"), "asked")
    of_shards = asked.where("shard >= 0")
    salts = max(1, -(-of_shards.count() // ((tries + words) * ASKED)))
    of_shards = of_shards.select("shard", F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int").alias("salt"), "run", "first", "keys", none("counts"))
    tables = model.tables.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("run"), F.lit(0).cast("long").alias("first"), "keys", "counts")
    with _rows_at_a_time(spark, ROWS):
        found = of_shards.unionByName(tables).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "run").mapInArrow(answer, "run long, first long, found binary")
        found = materialise(found, "answers")
        runs = asked.where("shard < 0").select("run", "first", none("found"), "texts")
        both = found.withColumn("texts", none("texts")).unionByName(runs).repartition("run").sortWithinPartitions("run", F.col("texts").isNotNull(), "first")
        schema = ", ".join(f"{k} {t}" for k, t in keep.items()) + ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return materialise(both.mapInArrow(finish, schema), "scores", keep=True)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _ipc(part: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(part)
    return sink.getvalue().to_pybytes()


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    docs = docs.select("doc_id", "text", (remainder == 2).alias("held_out"))
    with scratch(spark):
        model = train(docs.where(~F.col("held_out")))
        return score(docs, model, {"doc_id": dict(docs.dtypes)["doc_id"], "held_out": "boolean"})
