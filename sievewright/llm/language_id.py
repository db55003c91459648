"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed
against it into phrases: from each place the longest match in the language's text is
taken, and the parse goes on at the character that broke it. Each phrase is a pointer into the language's text of n letters and costs
log2(n) bits, so phrases are normalised by the length of that text: the language that needs the fewest bits a letter wins.

The automata are flattened to tables with the restart built in, so that a step of the parse is one
lookup, done for thousands of text segments at once. The commonest letters have a column each, as far as memory is allotted, the other edges are kept
sparse. A phrase never crosses the border of a segment (SEGMENT letters), which costs every language the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import cut, quoted

#: Bound of the labelled sample: documents looked at per language (expected), and characters kept per language.
SAMPLE_DOCS = 120
SAMPLE_CHARS = 60_000
#: A sampled document gives at most so many characters, taken from its middle.
SAMPLE_SLICE = 4_000
#: Letters of all samples together; more languages than SAMPLES / SAMPLE_CHARS get shorter samples.
SAMPLES = 4_000_000
#: Memory of all dense tables together, in entries of 4 bytes.
DENSE = 32_000_000
SEGMENT = 512
LANES = 8192
#: Letters of the texts that are parsed together.
TOGETHER = 4_000_000
#: A text that costs more than so many times the bits of its language's own held-back text is of no learned language.
FOREIGN = 1.5
FOLDS = 5
SEED = 77


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other than letters made one space."""
    low = text.lower()
    code = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32).copy()
    if not len(code):
        return code
    code[~_is_letter(code)] = 32
    space = code == 32
    return code[~(space & np.concatenate(([True], space[:-1])))]


def _letter_table() -> np.ndarray:
    out = np.zeros(0x110000, dtype=bool)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            out[i] = True
    return out


_tables: dict = {}


def _is_letter(code: np.ndarray) -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = _letter_table()
    return _tables["letters"][code]


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions and suffix links; state 0 is the empty match."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt, link


class Model:
    """Parse tables per language over a common alphabet."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self._ready: list[np.ndarray] | None = None
        codes = {k: letters(texts[k]) for k in self.langs}
        seen = np.concatenate([*codes.values(), np.array([32], np.uint32)])
        letter, often = np.unique(seen, return_counts=True)
        letter = letter[np.argsort(-often, kind="stable")]  # the commonest first
        #: symbol 0: a letter that no sample has
        self.symbol = np.zeros(0x110000, dtype=np.uint32)
        self.symbol[letter] = np.arange(1, len(letter) + 1)
        self.width = len(letter) + 1
        self.size = {k: max(2, len(codes[k])) for k in self.langs}
        self.edges = {}
        for k in self.langs:
            nxt, _ = suffix_automaton(self.symbol[codes[k]].tolist())
            src = np.repeat(np.arange(len(nxt)), [len(d) for d in nxt]).astype(np.int32)
            sym = np.fromiter((c for d in nxt for c in d), np.uint32, len(src))
            dst = np.fromiter((s for d in nxt for s in d.values()), np.int32, len(src))
            self.edges[k] = (len(nxt), src, sym, dst)
        states = sum(e[0] for e in self.edges.values())
        #: symbols below this have a column in the dense tables
        self.dense = min(self.width, max(1, DENSE // max(states, 1)))
        #: bits a letter that text of the language costs which isn't in the sample it is parsed against
        self.usual = {k: self._usual(codes[k]) for k in self.langs}

    @staticmethod
    def _usual(code: np.ndarray) -> float:
        """Bits a letter of the last fifth of a text parsed against the rest of it."""
        at = len(code) * 4 // 5
        head, tail = code[:at].tolist(), code[at:].tolist()
        if len(tail) < 50:
            return math.inf  # too little to tell
        nxt, _ = suffix_automaton(head)
        state, n = 0, 0
        for i, c in enumerate(tail):
            step = None if i % SEGMENT == 0 else nxt[state].get(c)
            if step is None:
                n, step = n + 1, nxt[0].get(c, 0)
            state = step
        return n * math.log2(max(2, len(head))) / len(tail)

    def table(self, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``next state * 2 + (1 if a new phrase begins)`` by state and symbol: a dense part, the keys and values of
        all other edges, and what begins a phrase."""
        n, src, sym, dst = self.edges[lang]
        first = np.zeros(self.width, dtype=np.int32)
        at_root = src == 0
        first[sym[at_root]] = dst[at_root]
        first = first * 2 + 1
        w = self.dense
        common = sym < w
        out = np.broadcast_to(first[:w], (n, w)).copy()
        out[src[common], sym[common]] = dst[common] * 2
        out[0] = first[:w]  # at the start every symbol begins a phrase
        rare = ~common & ~at_root
        key = src[rare].astype(np.int64) * self.width + sym[rare]
        order = np.argsort(key)
        return out.ravel(), key[order], dst[rare][order] * 2, first

    def tables(self) -> list[tuple]:
        if self._ready is None:
            self._ready = [self.table(k) for k in self.langs]
        return self._ready

    def advance(self, table: tuple, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        dense, keys, values, first = table
        if self.dense == self.width:
            return dense[state * self.width + symbol]
        common = symbol < self.dense
        got = dense[state * self.dense + np.where(common, symbol, 0)]
        at = np.flatnonzero(~common)
        if len(at):
            key = state[at] * self.width + symbol[at]
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            met = keys[place] == key if len(keys) else np.zeros(len(at), bool)
            got[at] = np.where(met, values[place] if len(keys) else 0, first[symbol[at]])
        return got

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_ready": None}

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each document (rows) against each language (columns)."""
        pieces, owner = [], []
        for i, d in enumerate(docs):
            for at in range(0, len(d), SEGMENT):
                pieces.append(d[at : at + SEGMENT])
                owner.append(i)
        out = np.zeros((len(docs), len(self.langs)), dtype=np.int64)
        order = np.argsort([-len(p) for p in pieces], kind="stable")
        for lo in range(0, len(order), LANES):
            part = [pieces[j] for j in order[lo : lo + LANES]]
            whose = np.array([owner[j] for j in order[lo : lo + LANES]])
            sizes = np.array([len(p) for p in part])
            most = int(sizes[0])
            grid = np.zeros((most, len(part)), dtype=np.int64 if self.width > 30_000 else np.int16)
            for j, p in enumerate(part):
                grid[: len(p), j] = self.symbol[p]
            live = np.searchsorted(-sizes, -np.arange(most), side="left")  # lanes longer than step
            for n, table in enumerate(self.tables()):
                state = np.zeros(len(part), dtype=np.int64)
                count = np.zeros(len(part), dtype=np.int64)
                for step in range(most):
                    k = live[step]
                    got = self.advance(table, state[:k], grid[step, :k])
                    count[:k] += got & 1
                    state[:k] = got >> 1
                np.add.at(out[:, n], whose, count)
        return out

    def bits(self, docs: list[np.ndarray]) -> np.ndarray:
        """Bits that each document (rows) costs against each language (columns)."""
        return self.phrases(docs) * np.log2([self.size[k] for k in self.langs])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score (how much of the runner-up's bits the winner saves, 0 to 1), and whether the text is like that language."""
        docs = [letters(t or "") for t in texts]
        cost = self.bits(docs) if self.langs else np.zeros((len(docs), 0))
        out = []
        for d, row in zip(docs, cost, strict=True):
            if not len(d) or not self.langs or (len(d) == 1 and d[0] == 32):
                out.append(("und", 0.0, False))
                continue
            best = int(np.argmin(row))  # ties: the first by name
            rest = np.delete(row, best)
            score = 1.0 if not len(rest) else float(1 - row[best] / rest.min())
            # a short text costs up to one phrase more
            own = row[best] - np.log2(self.size[self.langs[best]]) <= FOREIGN * self.usual[self.langs[best]] * len(d)
            out.append((self.langs[best], score, bool(own)))
        return out


def held_out(doc_id) -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text is 0 mod FOLDS, or no id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on a bounded, hash-chosen sample of labelled documents that aren't held out."""
    seen = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = cut(seen.groupBy(F.col(lang).alias("_label")).agg(F.count("*").alias("_of")))
    sizes = [r[0] for r in counts.select("_label").collect()]
    if not sizes:
        return Model({})
    u = F.pmod(F.xxhash64(F.lit(SEED), F.col(doc_id)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    start = F.greatest(F.lit(1), F.floor(F.char_length(text) / 2 - SAMPLE_SLICE / 2).cast("int"))
    rows = (
        # one row for each label, as the model has a text for each
        seen.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.substring(F.col(text), start, F.lit(SAMPLE_SLICE)).alias("t"), u.alias("u"))
        .join(F.broadcast(counts), F.col("l") == F.col("_label")).where(F.col("u") < F.lit(float(SAMPLE_DOCS)) / F.col("_of")).select("i", "l", "t")
        .limit(4 * SAMPLE_DOCS * len(sizes))
        .collect()
    )
    texts: dict[str, list[str]] = {k: [] for k in sizes}
    for r in sorted(rows, key=lambda r: (r["l"], r["i"])):
        texts[r["l"]].append(r["t"])
    most = min(SAMPLE_CHARS, SAMPLES // len(sizes))
    return Model({k: " ".join(v)[:most] for k, v in texts.items() if v})


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Predict the language of each whole text: ``doc_id, held_out, lang_pred, score``.

    ``lang_pred`` is ``und`` with score 0 if the text is null or has no letter, or if there was nothing to
    learn from. Ties go to the first language by name. One row comes out per row, whatever its other columns.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return label(ids, model, "text").select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def _together(batch: pa.RecordBatch, at_text: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about TOGETHER letters, at least a row each."""
    lo = held = 0
    for i, t in enumerate(batch.column(at_text)):
        size = len(t.as_py()) if t.is_valid else 0
        if i > lo and held + size > TOGETHER:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += size
    yield batch.slice(lo)


def label(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "_lang", score_out: str = "_score", known_out: str = "_known") -> DataFrame:
    """All columns of ``docs``, and ``lang_out``, ``score_out`` and ``known_out`` (whether the text is like the language at all), which
    replace columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(lang_out, score_out, known_out)
    # the columns travel as one struct, whatever their names
    held = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), docs[quoted(text)].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in (x for b in batches for x in _together(b, 1)):
            got = m.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x for x, _, _ in got], pa.string()),
                    pa.array([s for _, s, _ in got], pa.float64()),
                    pa.array([k for _, _, k in got], pa.bool_()),
                ],
                names=["row", "lang", "score", "known"],
            )

    schema = T.StructType([T.StructField("row", held.schema["row"].dataType), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType())])
    got = held.mapInArrow(run, schema)
    added = [F.col(c).alias(out) for c, out in (("lang", lang_out), ("score", score_out), ("known", known_out))]
    return got.select(*[F.col("row")[c].alias(c) for c in docs.columns], *added)


def known(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` in a learned language (one of ``languages``, if given), with their columns.

    Rejected are texts without a letter, null ones among them, and those that cost FOREIGN times the bits a letter of their
    best language's own text, as random letters or an unlearned language do. The column ``lang``, where there is one, gets the predicted language
    where it is null. Repeated rows are judged alike, a row's other columns don't matter, and an empty table stays empty.
    """
    taken = {c.lower() for c in docs.columns}
    out = ["_lang", "_score", "_known"]
    while taken & set(out):
        out = ["_" + x for x in out]
    got = label(docs, model, text, *out)
    good = F.col(out[2]) if languages is None else F.col(out[2]) & F.col(out[0]).isin(languages)
    filled = [F.coalesce(F.col(quoted(c)), F.col(out[0])).alias(c) if c == lang else F.col(quoted(c)) for c in docs.columns]
    return got.where(good).select(*filled)
