"""LM scoring by masked pseudo-likelihood.

Each token is predicted from its neighbours on both sides by a small window network
trained in numpy; a document's score sums the log-probabilities of all its tokens.

Words are counted over the whole corpus. The most frequent have tokens of their own; a rarer word is the token of its first two bytes
(hashed into BUCKETS groups), predicted from both sides like any other, and then its spelling given that group: byte by byte up to the
end of the word, each given the two before it, from counts over all rare words. So every word has a
probability of its own, and a rare neighbour tells how it begins.

Training doesn't depend on how the table is partitioned: documents are dealt by hash to shards of about SHARD tokens, each shard trains
from the same weights on its documents in the order of their hashes, and weights are averaged by a tree of sums, for some rounds.

The network: embeddings of WINDOW tokens on each side (one table per place), summed, tanh, then a
two-level softmax: a class, then the token in the class. Token and class tables have about sqrt(vocabulary) entries each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import cut, width

WINDOW = 2
DIM = 16
CLASSES = 32
PER_CLASS = 32
ROUNDS = 2
RATE = 0.8
#: Each round of training looks at one in so many positions of every document, another one each; with as many
#: rounds as positions, all are seen once.
STRIDE = ROUNDS
BATCH = 8192
#: Tokens of a shard, about.
SHARD = 1 << 20
_SEED = 5
SIZE = CLASSES * PER_CLASS
#: Id 0 stands for the outside of a document; then come words, then, from RARE on, the groups of rarer words.
EDGE = 0
BUCKETS = 256
RARE = SIZE - BUCKETS
#: Spelling: a word ends with END, a byte that none holds; the byte before the last counts by its low five bits.
END, OLDER = 32, 33
CELLS = OLDER * 256 * 256
#: How many occurrences the shorter context weighs.
BACK = 4.0
#: Distinct words that a task remembers, about, before it begins anew.
HELD = 200_000


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n`` of all words of the corpus, cut as ``words`` does and counted with partial sums; a null word stands for all of them."""
    source = docs.select(F.col(text).alias("_text_")).where(F.col("_text_").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                held.update(words(t.as_py()))
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)

    return source.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def top_words(counted: DataFrame) -> tuple[list[str], np.ndarray, int]:
    """The most frequent words of the whole corpus (ties by name), at most ``RARE - 1``, how often each occurs, and the number of all words."""
    rows = counted.orderBy(F.col("n").desc(), "word").limit(RARE).collect()
    total = sum(r["n"] for r in rows if r["word"] is None)
    top = [r for r in rows if r["word"] is not None][: RARE - 1]
    return [r["word"] for r in top], np.array([r["n"] for r in top], np.int64), total


def _counts(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([*held, None], pa.string()), pa.array([*held.values(), sum(held.values())], pa.int64())],
        names=["word", "n"],
    )


_CELL_OF_LAST = np.arange(256) * 256
_CELL_OF_OLDER = np.arange(256) % 32 * 65536
_CELL_OF_OLDER[END] = (OLDER - 1) * 65536


def _spelled(rare: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the spelling table for every byte of the words and their ends, and where each word starts."""
    data = np.frombuffer((" " + " ".join(rare) + " ").encode(), np.uint8)
    start = np.flatnonzero(data[:-1] == END)
    cells = np.empty(len(data) - 1, np.int64)
    cells[1:] = _CELL_OF_OLDER[data[:-2]]
    cells[start] = _CELL_OF_OLDER[END]  # words stand alone
    cells += _CELL_OF_LAST[data[:-1]]
    cells += data[1:]
    return cells, start


def spelling(counted: DataFrame, vocab: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of a byte given the two before it, flat, from all words that aren't in ``vocab``, and how often each group of them occurs."""
    known = counted.sparkSession.sparkContext.broadcast(set(vocab))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(CELLS + BUCKETS, np.int64)
        for batch in batches:
            rows = [(w, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if w not in known.value]
            if rows:
                cells, start = _spelled([w for w, _ in rows])
                often = np.repeat(np.array([n for _, n in rows]), np.diff(np.append(start, len(cells))))
                at, back = np.unique(cells, return_inverse=True)
                held[at] += np.bincount(back, often).astype(np.int64)
                held[CELLS:] += np.bincount(_groups(cells, start), [n for _, n in rows], BUCKETS).astype(np.int64)
        at = np.flatnonzero(held)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["cell", "n"])

    found = counted.where(F.col("word").isNotNull()).select("word", "n").mapInArrow(count, "cell bigint, n bigint")
    rows = found.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most one row a cell
    seen = np.zeros(CELLS + BUCKETS)
    seen[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    groups = seen[CELLS:].astype(np.int64)
    seen = seen[:CELLS].reshape(OLDER, 256, 256)
    pair = seen.sum(axis=0)
    one = pair.sum(axis=0)
    one = (one + 1) / (one.sum() + 256)
    pair = (pair + BACK * one) / (pair.sum(axis=1, keepdims=True) + BACK)
    total = seen.sum(axis=2, keepdims=True)
    seen += BACK * pair
    seen /= total + BACK
    return np.log(seen).astype(np.float32).ravel(), groups


def _bucket(head: bytes) -> int:
    """The group of a word by its first two bytes, or its one byte and END."""
    return ((head[0] << 8 | (head[1] if len(head) > 1 else END)) * 40503 >> 4) % BUCKETS


_BUCKETS = np.array([[_bucket(bytes([a, b])) for b in range(256)] for a in range(256)])


def _groups(cells: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The groups of words by what ``_spelled`` gives of them."""
    return _BUCKETS[cells[start] % 256, cells[start + 1] % 256]


def bucket_log_probabilities(table: np.ndarray) -> np.ndarray:
    """Log-probability that spelling begins with a pair of bytes of each group."""
    t = table.reshape(OLDER, 256, 256)[OLDER - 1].astype(np.float64)
    pair = np.exp(t[END][:, None] + t)  # the first byte, then the second given it alone
    pair[END] = 0  # no word begins with END
    return np.log(np.bincount(_BUCKETS.ravel(), pair.ravel(), BUCKETS))


def spelling_log_probabilities(table: np.ndarray, rare: list[str]) -> np.ndarray:
    """Log-probability of each word's spelling, regardless of its group."""
    cells, start = _spelled(rare)
    return np.add.reduceat(table[cells].astype(np.float64), start)


def initial(often: np.ndarray | None = None, seed: int = _SEED, dim: int = DIM) -> np.ndarray:
    """Weights as one flat array; biases follow how ``often`` each id occurs, so that training begins at the frequencies."""
    rng = np.random.default_rng(seed)
    sizes = shapes(dim)
    parts = [rng.normal(0, 0.1, s) for s in sizes]
    p = (np.ones(SIZE) if often is None else often + 1.0).reshape(PER_CLASS, CLASSES)  # id = inner * CLASSES + class
    parts[2][:] = np.log(p.sum(axis=0) / p.sum())
    parts[4][:] = np.log(p / p.sum(axis=0)).T
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def shapes(dim: int = DIM) -> list[tuple[int, ...]]:
    v = SIZE
    return [(2 * WINDOW * v, dim), (dim, CLASSES), (CLASSES,), (CLASSES, dim, PER_CLASS), (CLASSES, PER_CLASS)]


def unpack(flat: np.ndarray, dim: int = DIM) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(dim):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def contexts(ids: np.ndarray) -> np.ndarray:
    """Rows of the embedding table for each position: WINDOW tokens left, then right."""
    return windows([ids])[0]


def windows(docs: list[np.ndarray], first: int = 0, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (each place of the window in one piece of memory) and targets of every ``stride``-th position of each document, from ``first`` on."""
    edge = np.full(WINDOW, EDGE, np.int16)
    line = np.concatenate([edge, *chain.from_iterable((d, edge) for d in docs)])  # neighbours share an edge
    sizes = np.array([len(d) for d in docs], np.int64)
    start = np.cumsum(sizes + WINDOW) - sizes
    n = np.maximum(-(-(sizes - first) // stride), 0)
    at = np.repeat(start + first - stride * (np.cumsum(n) - n), n) + stride * np.arange(n.sum())
    ctx = np.empty((2 * WINDOW, len(at)), np.int64)
    for k, off in enumerate(o for o in range(-WINDOW, WINDOW + 1) if o):
        ctx[k] = line[at + off]
        ctx[k] += k * SIZE
    return ctx.T, line[at].astype(np.int64)


def _hidden(e: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    h = e.take(ctx[:, 0], axis=0)
    for k in range(1, ctx.shape[1]):
        h += e.take(ctx[:, k], axis=0)
    return np.tanh(h, out=h)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """An order by class, in it the class of each target and its place therein, and where each class is."""
    cls = (target % CLASSES).astype(np.uint8)
    order = np.argsort(cls, kind="stable")
    edge = np.cumsum([0, *np.bincount(cls, minlength=CLASSES)]).tolist()
    return order, cls[order], target[order] // CLASSES, [slice(lo, hi) for lo, hi in zip(edge[:-1], edge[1:], strict=True)]


def _logits(h: np.ndarray, wc: np.ndarray, bc: np.ndarray, ww: np.ndarray, bw: np.ndarray, held: list[slice]) -> tuple[np.ndarray, np.ndarray]:
    """Of the classes, and of the tokens in each position's own class: a column for each position, so that sums go along whole rows.

    Spark's workers do products in one thread (``OMP_NUM_THREADS`` is ``spark.task.cpus``), so they aren't cut into small pieces.
    """
    outer = wc.T @ h.T
    outer += bc[:, None]
    inner = np.empty((PER_CLASS, len(h)), h.dtype)
    for k, at in enumerate(held):
        if at.start != at.stop:
            np.matmul(ww[k].T, h[at].T, out=inner[:, at])
            inner[:, at] += bw[k][:, None]
    return outer, inner


def log_probabilities(flat: np.ndarray, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target given its context."""
    e, *tables = unpack(flat)
    out = np.empty(len(target), dtype=np.float64)
    for lo in range(0, len(target), BATCH):
        order, cls, inner, held = _by_class(target[lo : lo + BATCH])
        h = _hidden(e, ctx[lo : lo + BATCH])[order]
        got, all_ = np.zeros(len(h), flat.dtype), np.arange(len(h))
        for z, own in zip(_logits(h, *tables, held), (cls, inner), strict=True):
            z -= z.max(axis=0)
            got += z[own, all_]
            got -= np.log(np.exp(z, out=z).sum(axis=0))
        out[lo + order] = got
    return out


def _errors(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The gradient of the mean log-probability by the logits, in their place."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z *= -1 / (len(own) * z.sum(axis=0))
    z[own, np.arange(len(own))] += z.dtype.type(1 / len(own))
    return z


#: Rates of the five tables against RATE: each place of the window and each class sees few of a batch's positions.
PACE = (32.0, 1.0, 1.0, 8.0, 8.0)


def step(flat: np.ndarray, ctx: np.ndarray, target: np.ndarray, rate: float = RATE, pace: tuple[float, ...] = PACE) -> None:
    """One step of gradient ascent of the mean log-probability, in place."""
    e, wc, bc, ww, bw = unpack(flat)
    order, cls, inner, held = _by_class(target)  # by class, so that a class is one slice
    ctx = ctx.T[:, order].T
    h = _hidden(e, ctx)
    g, d = (_errors(z, own) for z, own in zip(_logits(h, wc, bc, ww, bw, held), (cls, inner), strict=True))
    dh = g.T @ wc.T
    for k, at in enumerate(held):
        if at.start != at.stop:
            dh[at] += d[:, at].T @ ww[k].T
            ww[k] += rate * pace[3] * (d[:, at] @ h[at]).T
            bw[k] += rate * pace[4] * d[:, at].sum(axis=1)
    wc += rate * pace[1] * (g @ h).T
    bc += rate * pace[2] * g.sum(axis=1)
    h *= h
    dh -= dh * h
    dh *= rate * pace[0]
    by_row = dh.T.astype(np.float64)
    for k in range(ctx.shape[1]):
        at = ctx[:, k] - k * SIZE
        e[k * SIZE : (k + 1) * SIZE] += np.stack([np.bincount(at, w, SIZE) for w in by_row], axis=1)


class Model:
    """The vocabulary and the spelling table, and the network's weights once it is trained."""

    def __init__(self, vocab: list[str], table: np.ndarray):
        self.vocab, self.table = vocab, table
        self.groups = bucket_log_probabilities(table)
        self.flat = initial()

    def reader(self):
        """A function of texts that gives the ids of each and the log-probability of all its rare words' spelling in their groups."""
        get = {w: i + 1 for i, w in enumerate(self.vocab)}.get

        def read(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
            split = [words(t) for t in texts]
            end = np.cumsum([len(w) for w in split])
            ids = np.fromiter(map(get, chain.from_iterable(split), repeat(0)), np.int16, end[-1])
            rare = ids == 0  # no word of the vocabulary has EDGE
            each = np.zeros(len(ids))
            if rare.any():
                cells, start = _spelled(list(compress(chain.from_iterable(split), rare.tolist())))
                group = _groups(cells, start)
                ids[rare] = group + RARE
                each[rare] = np.add.reduceat(self.table[cells].astype(np.float64), start) - self.groups[group]
            spelled = np.zeros(len(split))
            full = np.flatnonzero(np.diff(end, prepend=0))
            if len(full):
                spelled[full] = np.add.reduceat(each, np.concatenate([[0], end])[full])
            return np.split(ids, end[:-1]), spelled

        return read


def _tokens(docs: DataFrame, model: Model, text: str, doc_id: str, shards: int) -> DataFrame:
    """``doc_id, shard, place, n, spelled, ids`` of every row: whole shards in a partition, by place, whatever the partitions of ``docs``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    known = F.col(doc_id).cast("long")
    source = docs.select(known.alias("doc_id"), F.xxhash64(F.lit(3), known, F.col(text)).alias("place"), F.col(text).alias("_text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = sent.value.reader()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids, spelled = read(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1), pa.array([len(i) for i in ids], pa.int64()),
                        pa.array(spelled), pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    names=["doc_id", "place", "n", "spelled", "ids"],
                )

    rows = source.mapInArrow(run, "doc_id bigint, place bigint, n bigint, spelled double, ids binary")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int"))
    parts = min(shards, 4 * width(spark))
    return rows.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "place", "doc_id")


def _train(tokens: DataFrame, flat: np.ndarray, turn: int, stride: int) -> tuple[int, np.ndarray | None]:
    """Positions seen, and the mean of the weights of all shards, each trained from ``flat``."""
    spark = tokens.sparkSession
    sent = spark.sparkContext.broadcast(flat)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(len(sent.value)), 0
        shard, own, seen = None, sent.value, 0
        left: list[tuple[np.ndarray, np.ndarray]] = []
        docs: list[np.ndarray] = []
        held = 0

        def work(last: bool):
            nonlocal held, seen, left, docs
            if held < (1 if last else BATCH):
                return
            if docs:
                left.append(windows(docs, turn % stride, stride))
            ctx, target = (np.concatenate(x) for x in zip(*left, strict=True))
            whole = held - held % BATCH
            for lo in range(0, whole, BATCH):
                step(own, ctx[lo : lo + BATCH], target[lo : lo + BATCH])
            if last and held > whole:  # what is left moves the weights by its share of a batch
                step(own, ctx[whole:], target[whole:], RATE * (held - whole) / BATCH)
                whole = held
            seen, held, left, docs = seen + whole, held - whole, [(ctx[whole:], target[whole:])], []

        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != shard:
                    work(True)
                    total, weight = total + own.astype(np.float64) * seen, weight + seen
                    shard, own, seen, held, left, docs = k, sent.value.copy(), 0, 0, [], []
                ids = np.frombuffer(row.as_buffer(), np.int16) if row.is_valid else np.zeros(0, np.int16)
                n = len(range(turn % stride, len(ids), stride))
                if n:
                    docs.append(ids)
                    held += n
                    if held >= BATCH:
                        work(False)
        work(True)
        total, weight = total + own.astype(np.float64) * seen, weight + seen
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "w"])

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["n"].to_pylist(), table["w"].to_pylist(), strict=True))
        total = sum(np.frombuffer(w) for _, w in rows)
        return pa.table({"n": pa.array([sum(n for n, _ in rows)], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})

    parts = cut(tokens.select("shard", "ids").mapInArrow(learn, "n bigint, w binary").withColumn("part", F.spark_partition_id()))
    fan = 16
    many = parts.count()
    while many > fan:  # sums meet in a tree: no task takes more than about fan of them
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        grouped = parts.groupBy("part").applyInArrow(
            lambda key, t: add(t.select(["n", "w"])).append_column("part", pa.array([key[0].as_py()], pa.int32())),
            "n bigint, w binary, part int",
        )
        parts = cut(grouped)
        many = parts.count()
    rows = [(r["n"], bytes(r["w"])) for r in parts.select("n", "w").collect()]
    if not rows:
        return 0, None
    total = add(pa.table({"n": [n for n, _ in rows], "w": pa.array([w for _, w in rows], pa.binary())}))
    n = total["n"][0].as_py()
    return n, (np.frombuffer(total["w"][0].as_py()) / n).astype(np.float32)


def prepare(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard: int = SHARD) -> tuple[Model, DataFrame]:
    """The untrained model, its biases at the frequencies, and the tokens of all documents."""
    counted = cut(word_counts(docs, text))
    vocab, often, total = top_words(counted)
    table, groups = spelling(counted, vocab)
    model = Model(vocab, table)
    model.flat = initial(np.concatenate([[0], often, np.zeros(RARE - 1 - len(often)), groups]))
    tokens = cut(_tokens(docs, model, text, doc_id, max(1, -(-total // shard))))
    return model, tokens


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS, stride: int = STRIDE, shard: int = SHARD) -> tuple[Model, DataFrame]:
    """The model trained on all documents, and their tokens: in a round every document gives each ``stride``-th position.

    Rounds start at different positions, so with ``rounds >= stride`` (the default) every position is seen. How ``docs`` is
    partitioned changes nothing but the order of sums.
    """
    model, tokens = prepare(docs, text, doc_id, shard)
    for turn in range(rounds):
        seen, flat = _train(tokens, model.flat, turn, stride)
        if not seen:
            break
        model.flat = flat
    return model, tokens


def _scores(rows: list[tuple], flat: np.ndarray) -> pa.RecordBatch:
    ids = [x for _, x, _ in rows]
    sizes = np.array([len(x) for x in ids])
    sums = np.array([s for _, _, s in rows])
    full = np.flatnonzero(sizes)
    if len(full):
        got = log_probabilities(flat, *windows([ids[i] for i in full]))
        sums[full] += np.add.reduceat(got, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = sums / sizes
    empty = sizes == 0
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _, _ in rows], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(mean, mask=empty), pa.array(np.exp(-mean), mask=empty)],
        names=["doc_id", "n_tokens", "log_likelihood", "score", "perplexity"],
    )


def score(tokens: DataFrame, model: Model) -> DataFrame:
    """Scores of the documents whose ``tokens`` a model has made: ``doc_id, n_tokens, log_likelihood, score, perplexity``."""
    sent = tokens.sparkSession.sparkContext.broadcast(model.flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i, row, spelled in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                held.append((i, np.frombuffer(row.as_buffer(), np.int16), spelled))
                size += len(held[-1][1]) + 1
                if size >= 1 << 16:  # texts of any length are taken together up to so many tokens
                    yield _scores(held, sent.value)
                    held, size = [], 0
        if held:
            yield _scores(held, sent.value)

    return tokens.select("doc_id", "ids", "spelled").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, log_likelihood double, score double, perplexity double"
    )


def tokens_of(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Tokens, for ``score``, of documents that the model needn't have seen."""
    return _tokens(docs, model, text, doc_id, width(docs.sparkSession))


def pseudo_likelihood(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Train on all of ``docs`` and score each whole text: ``doc_id, n_tokens, log_likelihood, score`` (mean per token), ``perplexity``.

    A null or blank text has no tokens, log-likelihood 0, and null score and perplexity. One row comes out per row, rows without an
    id or with a repeated one included. Other columns aren't read; an empty table gives an empty result.
    """
    model, tokens = train(docs, text, doc_id)
    return score(tokens, model)
